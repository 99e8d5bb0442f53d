"""Product model of an exchange file: products, representations, occurrences, bodies, styles, colours, faces and boxes, as frames.

All from ``entities(row, id, type, text, refs)``. Keys are ids; ``row`` orders. A reference resolves to the last record of its id.
"""

from __future__ import annotations

from functools import cached_property

from pyspark.sql import Column, DataFrame, functions as F

from ..functions import part21 as p21
from ..shared import cut
from . import graph

# Fixed values of the schema: record types by their part in the model.
BODIES = ["MANIFOLD_SOLID_BREP", "BREP_WITH_VOIDS", "SHELL_BASED_SURFACE_MODEL", "FACETED_BREP"]
REPRESENTATIONS = [
    "ADVANCED_BREP_SHAPE_REPRESENTATION", "MANIFOLD_SURFACE_SHAPE_REPRESENTATION", "SHAPE_REPRESENTATION", "FACETED_BREP_SHAPE_REPRESENTATION",
    "GEOMETRICALLY_BOUNDED_SURFACE_SHAPE_REPRESENTATION", "GEOMETRICALLY_BOUNDED_WIREFRAME_SHAPE_REPRESENTATION",
]
SHELLS = ["CLOSED_SHELL", "OPEN_SHELL"]
TOPOLOGY = [
    "CLOSED_SHELL", "OPEN_SHELL", "ORIENTED_CLOSED_SHELL", "ORIENTED_OPEN_SHELL", "SHELL_BASED_SURFACE_MODEL", "BREP_WITH_VOIDS", "MANIFOLD_SOLID_BREP", "FACETED_BREP",
    "FACE_OUTER_BOUND", "FACE_BOUND", "EDGE_LOOP", "ORIENTED_EDGE", "EDGE_CURVE", "VERTEX_POINT", "VERTEX_LOOP", "ORIENTED_FACE",
]
#: Records that belong to a part because they point at it: by the reference at a position (from the end if negative), or by a list that is
#: narrowed to the part's members.
KEYED = {
    "STYLED_ITEM": -1, "OVER_RIDING_STYLED_ITEM": -2, "PROPERTY_DEFINITION": -1, "PROPERTY_DEFINITION_REPRESENTATION": 0, "APPLICATION_PROTOCOL_DEFINITION": -1,
    "PRODUCT_CATEGORY_RELATIONSHIP": -1, "APPROVAL_DATE_TIME": -1, "APPROVAL_PERSON_ORGANIZATION": 1,
}
LISTED = [
    "PRODUCT_RELATED_PRODUCT_CATEGORY", "PRESENTATION_LAYER_ASSIGNMENT", "MECHANICAL_DESIGN_GEOMETRIC_PRESENTATION_REPRESENTATION", "CC_DESIGN_PERSON_AND_ORGANIZATION_ASSIGNMENT",
    "CC_DESIGN_DATE_AND_TIME_ASSIGNMENT", "CC_DESIGN_SECURITY_CLASSIFICATION", "CC_DESIGN_APPROVAL",
]
NAMED_COLOURS = {
    "red": (1.0, 0.0, 0.0), "green": (0.0, 1.0, 0.0), "blue": (0.0, 0.0, 1.0), "yellow": (1.0, 1.0, 0.0),
    "magenta": (1.0, 0.0, 1.0), "cyan": (0.0, 1.0, 1.0), "black": (0.0, 0.0, 0.0), "white": (1.0, 1.0, 1.0),
}
COLOUR, NAMED_COLOUR, SIDE, CURVE, FACE, VERTEX, POINT = "COLOUR_RGB", "DRAUGHTING_PRE_DEFINED_COLOUR", "SURFACE_STYLE_USAGE", "CURVE_STYLE", "ADVANCED_FACE", "VERTEX_POINT", "CARTESIAN_POINT"
#: References that may lie between a style and its colour.
COLOUR_DEPTH = 9

c = F.col


def args(text: Column) -> Column:
    """What stands between a record's first and last bracket."""
    return F.regexp_extract(text.cast("string"), r"(?s)^[^(]*\((.*)\)", 1)


def _colour(kind: str, arguments: str) -> str:
    raw = p21.leading_string(arguments)
    if raw is None:
        return p21.colour_key(0.0, 0.0, 0.0)
    if kind == NAMED_COLOUR:
        return p21.colour_key(*NAMED_COLOURS.get(p21.decode_string(raw), (0.0, 0.0, 0.0)))
    found = p21.numbers(arguments[len(raw) + 2 :], 3)
    return p21.colour_key(*(found + [0.0] * 3)[:3])


class ProductModel:
    def __init__(self, entities: DataFrame):
        self.entities = cut(graph.last_definitions(entities).withColumn("args", args(c("text"))))
        known = self.entities.select(c("id").alias("dst"), c("type").alias("dst_type"))
        all_refs = graph.references(self.entities).join(self.entities.select(c("id").alias("src"), c("row").alias("src_row"), c("type").alias("src_type")), "src")
        self.refs = cut(all_refs.join(known, "dst"))  # references that resolve

    def of(self, *types: str) -> DataFrame:
        return self.entities.where(c("type").isin(*types))

    def _first(self, types: list[str], targets: DataFrame) -> DataFrame:
        """(id, value): for each record of the types, the value of its first reference that has one in ``targets(id, value)``."""
        hits = self.refs.where(c("src_type").isin(*types)).join(targets.select(c("id").alias("dst"), "value"), "dst")
        return hits.groupBy(c("src").alias("id")).agg(F.min_by("value", "pos").alias("value"))

    def _at(self, types: list[str], pos: int, name: str) -> DataFrame:
        return graph.argument(self.refs.where(c("src_type").isin(*types)), pos).toDF("id", name)

    @cached_property
    def products(self) -> DataFrame:
        """(id, row, name); a product without a leading string has an empty name."""
        return cut(self.of("PRODUCT").select("id", "row", F.coalesce(p21.udf_of(lambda a: p21.first_string(a) or "", "string")(c("args")), F.lit("")).alias("name")))

    @cached_property
    def definitions(self) -> DataFrame:
        """(id, value): definition to product."""
        formations = self._first(["PRODUCT_DEFINITION_FORMATION", "PRODUCT_DEFINITION_FORMATION_WITH_SPECIFIED_SOURCE"], self.products.select("id", c("id").alias("value")))
        return cut(self._first(["PRODUCT_DEFINITION", "PRODUCT_DEFINITION_WITH_ASSOCIATED_DOCUMENTS"], formations))

    @cached_property
    def shape_links(self) -> DataFrame:
        """(link, row, rep, product): shape definition representations whose shape belongs to a product."""
        shapes = self._at(["PRODUCT_DEFINITION_SHAPE"], 0, "definition").join(self.definitions.select(c("id").alias("definition"), c("value").alias("product")), "definition").select(c("id").alias("shape"), "product")
        links = self._at(["SHAPE_DEFINITION_REPRESENTATION"], 0, "shape").join(self._at(["SHAPE_DEFINITION_REPRESENTATION"], 1, "rep"), "id").join(shapes, "shape")
        return cut(links.join(self.entities.select("id", "row"), "id").select(c("id").alias("link"), "row", "rep", "product"))

    @cached_property
    def relations(self) -> DataFrame:
        """(id, row, a, b): relationships between two representations."""
        kind = ["SHAPE_REPRESENTATION_RELATIONSHIP"]
        return cut(self._at(kind, 0, "a").join(self._at(kind, 1, "b"), "id").join(self.entities.select("id", "row"), "id"))

    @cached_property
    def representations(self) -> DataFrame:
        """(id, owner): representation to product, spread over relationships."""
        direct = self.shape_links.groupBy(c("rep").alias("id")).agg(F.max_by("product", "row").alias("owner"))
        return cut(graph.propagate(self.relations, direct).select("id", "owner"))

    @cached_property
    def occurrences(self) -> DataFrame:
        """(id, row, parent, child): products of an assembly use; what doesn't resolve is null."""
        kind = ["NEXT_ASSEMBLY_USAGE_OCCURRENCE"]
        product = lambda pos, name: self._at(kind, pos, "d").join(self.definitions.select(c("id").alias("d"), c("value").alias(name)), "d").select("id", name)
        return cut(self.of(*kind).select("id", "row").join(product(0, "parent"), "id", "left").join(product(1, "child"), "id", "left"))

    @cached_property
    def roots(self) -> DataFrame:
        known = self.occurrences.where("child is not null").select("parent", "child")
        top = self.products.select("id").join(known.select(c("child").alias("id")), "id", "left_anti")
        held = self.occurrences.where("parent is not null").select(c("parent").alias("id")).unionByName(self.representations.select(c("owner").alias("id")))
        return top.join(held.distinct(), "id", "left_semi")

    @cached_property
    def bodies(self) -> DataFrame:
        """(body, rep, product): each body once, in a representation that a product owns if there is one, else in the first."""
        text = c("text").cast("string")
        plain = c("type").isin(*REPRESENTATIONS) | ((c("type") == "CPLX") & text.contains("SHAPE_REPRESENTATION(") & ~text.contains("RELATIONSHIP"))
        reps = self.entities.where(plain).select(c("id").alias("rep"), "row").join(self.representations.select(c("id").alias("rep"), "owner"), "rep", "left")
        inside = self.refs.where(c("dst_type").isin(*BODIES)).select(c("src").alias("rep"), c("dst").alias("body")).join(reps, "rep")
        best = inside.groupBy("body").agg(F.min_by(F.struct("rep", "owner"), F.struct(c("owner").isNull(), "row")).alias("b"))
        return cut(best.select("body", c("b.rep").alias("rep"), c("b.owner").alias("product")))

    @cached_property
    def colours(self) -> DataFrame:
        """(id, key): canonical colour of each colour record."""
        return cut(self.of(COLOUR, NAMED_COLOUR).select("id", p21.udf_of(_colour, "string")(c("type"), c("args")).alias("key")))

    @cached_property
    def styles(self) -> DataFrame:
        """(style, row, target, surface, curve, overriding). The front of a surface wins over its back; the first by breadth counts."""
        own = self.refs.where(c("src_type").isin("STYLED_ITEM", "OVER_RIDING_STYLED_ITEM")).withColumn("_end", F.when(c("src_type") == "STYLED_ITEM", -1).otherwise(-2))
        items = own.where("back = _end").select(c("src").alias("style"), c("src_row").alias("row"), c("dst").alias("target"), (c("src_type") == "OVER_RIDING_STYLED_ITEM").alias("overriding"))
        edge = self.refs.select(c("src").alias("parent"), c("dst").alias("child"), c("pos").alias("slot"), "src_type", "back")
        first = own.where("back < _end").select(c("src").alias("parent"), c("dst").alias("child"), c("pos").alias("slot"))
        further = edge.where(~c("src_type").isin(SIDE, CURVE, "STYLED_ITEM", "OVER_RIDING_STYLED_ITEM")).select("parent", "child", "slot")
        tops = items.select(c("style").alias("id")).distinct()
        walk = graph.paths(tops, cut(first.unionByName(further)), fail_on_cycle=False).join(self.entities.select("id", "type", "args"), "id").where(c("type").isin(SIDE, CURVE)).select("root", "id", "depth", "slots", "type", "args")
        walk = cut(walk)
        to_colour = graph.paths(walk.select("id").distinct(), cut(edge.where(~c("src_type").isin(COLOUR, NAMED_COLOUR)).select("parent", "child", "slot")), max_depth=COLOUR_DEPTH, fail_on_cycle=False)
        keyed = to_colour.join(self.colours, "id").groupBy(c("root").alias("id")).agg(F.min_by("key", "slots").alias("key"))
        place = F.struct("depth", "slots")
        negative = p21.first_argument_column(c("args")) == ".NEGATIVE."
        pick = lambda test: F.min_by(F.when(test, c("key")), F.when(test, place))
        told = walk.join(keyed, "id").groupBy(c("root").alias("style")).agg(pick((c("type") == SIDE) & ~negative).alias("front"), pick((c("type") == SIDE) & negative).alias("behind"), pick(c("type") == CURVE).alias("curve"))
        return cut(items.join(told, "style", "left").select("style", "row", "target", F.coalesce("front", "behind").alias("surface"), "curve", "overriding"))

    @cached_property
    def surface_colours(self) -> DataFrame:
        """(id, colour): the first style of a record, in file order, that has a surface colour."""
        return cut(self.styles.where("surface is not null").groupBy(c("target").alias("id")).agg(F.min_by("surface", "row").alias("colour")))

    @cached_property
    def faces(self) -> DataFrame:
        """(body, face, shell): faces of each body once, with the last shell on the way; the last reference of a record is followed first."""
        edges = self.refs.where(c("src_type").isin(*TOPOLOGY, "CPLX")).select(c("src").alias("parent"), c("dst").alias("child"), (-c("pos")).alias("slot"), "dst_type")
        carry = {"shell": (F.lit(None).cast("bigint"), F.when(c("dst_type").isin(*SHELLS), c("child")).otherwise(c("p_shell")))}
        down = graph.paths(self.bodies.select(c("body").alias("id")), cut(edges), carry, fail_on_cycle=False)
        faces = down.join(self.of(FACE).select("id"), "id", "left_semi")
        return cut(faces.groupBy(c("root").alias("body"), c("id").alias("face")).agg(F.min_by(F.struct("shell"), "slots")["shell"].alias("shell")))

    @cached_property
    def face_colours(self) -> DataFrame:
        """(body, colour, n): the face's colour, else its shell's, else the body's."""
        by = lambda name: self.surface_colours.select(c("id").alias(name), c("colour").alias(f"{name}_colour"))
        joined = self.faces.join(by("face"), "face", "left").join(by("shell"), "shell", "left").join(by("body"), "body", "left")
        return joined.groupBy("body", F.coalesce("face_colour", "shell_colour", "body_colour").alias("colour")).agg(F.count("*").alias("n"))

    @cached_property
    def extra_outer_bounds(self) -> DataFrame:
        """(body, extra): outer bounds beyond the first of each face."""
        bounds = self.refs.where((c("src_type") == FACE) & (c("dst_type") == "FACE_OUTER_BOUND") & (c("back") < -1)).groupBy(c("src").alias("face")).agg(F.count("*").alias("n"))
        return self.faces.join(bounds, "face", "left").groupBy("body").agg(F.sum(F.greatest(F.coalesce("n", F.lit(0)) - 1, F.lit(0))).alias("extra"))

    @cached_property
    def uses(self) -> DataFrame:
        """(owner, pos, child, orientation): ordered uses of topology; orientation 1 or -1 where the record's last operand is a flag, else 0."""
        flag = F.regexp_extract("args", r"\.([TF])\.\s*$", 1)
        told = self.of(*TOPOLOGY, FACE).select(c("id").alias("src"), F.when(flag == "T", 1).when(flag == "F", -1).otherwise(0).alias("orientation"))
        return self.refs.join(told, "src").where(c("dst_type").isin(*TOPOLOGY, FACE, POINT)).select(c("src").alias("owner"), "pos", c("dst").alias("child"), "orientation")

    @cached_property
    def boxes(self) -> DataFrame:
        """(body, low, high, vertices): extent of the vertex points that a body reaches, each record once; bodies without any are left out."""
        topology = self.refs.where(c("src_type").isin(*[t for t in TOPOLOGY if t != VERTEX], "CPLX") | ((c("src_type") == FACE) & (c("back") < -1)))
        reached = graph.forward_closure(cut(topology.select("src", "dst")), self.bodies.select(c("body").alias("part"), c("body").alias("id")))
        ends = self.refs.where((c("src_type") == VERTEX) & (c("dst_type") == POINT)).select(c("src").alias("id"), c("dst").alias("point"))
        at = self.of(POINT).select(c("id").alias("point"), p21.numbers_column(F.regexp_extract("args", r"(?s)\((.*)\)", 1)).alias("p"))
        met = reached.join(ends, "id").join(at, "point")
        axis = lambda f: F.array(*[f(F.coalesce(F.get("p", F.lit(k)), F.lit(0.0))) for k in range(3)])
        return met.groupBy(c("part").alias("body")).agg(axis(F.min).alias("low"), axis(F.max).alias("high"), F.count("*").alias("vertices"))

    @cached_property
    def seeds(self) -> DataFrame:
        """(part, id): what a product's part grows from: its shape links, and relationships with both ends among its representations."""
        owner = self.representations
        last = self.shape_links.groupBy("rep").agg(F.max_by("link", "row").alias("id")).join(owner.select(c("id").alias("rep"), c("owner").alias("part")), "rep").select("part", "id")
        ends = lambda side: owner.select(c("id").alias(side), c("owner").alias(f"own_{side}"))
        both = self.relations.join(ends("a"), "a").join(ends("b"), "b").where("own_a = own_b").select(c("own_a").alias("part"), "id")
        return last.unionByName(both).distinct()

    def split(self, rounds: int = 6) -> tuple[DataFrame, DataFrame, bool]:
        """(rows(part, row, id, text), membership(part, id), whether it ended): each product as a part of its own; narrowed lists rewritten."""
        keyed = None
        for kind, pos in KEYED.items():
            one = graph.argument(self.refs.where(c("src_type") == kind), pos).toDF("owner", "target")
            keyed = one if keyed is None else keyed.unionByName(one)
        lists = self.of(*LISTED).select(c("id").alias("owner"), F.posexplode(p21.udf_of(_list_of, "array<bigint>")(c("text").cast("string"))).alias("pos", "member"))
        rows, kept, ended = graph.policy_closure(cut(self.refs.select("src", "dst")), self.seeds, cut(keyed), cut(lists), rounds)
        members = kept.groupBy("part", c("owner").alias("id")).agg(F.transform(F.sort_array(F.collect_list(F.struct("pos", "member"))), lambda x: x["member"]).alias("members"))
        told = rows.join(self.entities.select("id", "row", c("text").cast("string").alias("text")), "id").join(members, ["part", "id"], "left")
        text = F.when(c("members").isNull(), c("text")).otherwise(p21.udf_of(_narrowed, "string")(c("text"), c("members")))
        return told.select("part", "row", "id", text.alias("text")), rows, ended


def _list_of(text: str) -> list[int]:
    """Ids of the first list of references alone in a record."""
    at = text.find("(")
    while at >= 0:
        if found := p21.reference_list(text[at:]):
            return found[1]
        at = text.find("(", at + 1)
    return []


def _narrowed(text: str, members) -> str:
    at = text.find("(")
    while not (found := p21.reference_list(text[at:])):
        at = text.find("(", at + 1)
    return text[:at] + p21.wrapped_list([int(m) for m in members]) + text[at + found[0] :]
