"""Nothing here: the engine's operators have no event time, watermarks or state. Any of the batch operators can run on the frames of a
``foreachBatch`` sink."""
