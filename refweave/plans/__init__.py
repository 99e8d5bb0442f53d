"""What is decided before rows move: named passes, job plans, settings."""
