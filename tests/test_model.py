import pytest
from pyspark.sql import functions as F
from refweave.operators import model
from refweave.sources import part21

RIG = """
#101=PRODUCT_CONTEXT('','mechanical',$);
#102=PRODUCT('rig','rig','',(#101));
#103=PRODUCT_DEFINITION_FORMATION('','',#102);
#104=PRODUCT_DEFINITION('','',#103,$);
#160=NEXT_ASSEMBLY_USAGE_OCCURRENCE('','','',#104,#112,$);
#110=PRODUCT('plate','plate','',(#101));
#111=PRODUCT_DEFINITION_FORMATION('','',#110);
#112=PRODUCT_DEFINITION('','',#111,$);
#113=PRODUCT_DEFINITION_SHAPE('','',#112);
#114=SHAPE_DEFINITION_REPRESENTATION(#113,#120);
#120=MANIFOLD_SURFACE_SHAPE_REPRESENTATION('',(#130),$);
#121=SHAPE_REPRESENTATION('',(#130),$);
#130=SHELL_BASED_SURFACE_MODEL('',(#131));
#131=OPEN_SHELL('',(#132,#133));
#132=ADVANCED_FACE('',(#140,#141,#142),#150,.T.);
#133=ADVANCED_FACE('',(#140),#150,.F.);
#140=FACE_OUTER_BOUND('',#143,.T.);
#141=FACE_OUTER_BOUND('',#143,.F.);
#142=FACE_OUTER_BOUND('',#143,.T.);
#143=EDGE_LOOP('',(#144));
#144=ORIENTED_EDGE('',*,*,#145,.F.);
#145=EDGE_CURVE('',#146,#147,#152,.T.);
#146=VERTEX_POINT('',#148);
#147=VERTEX_POINT('',#149);
#148=CARTESIAN_POINT('',(12.5,0.,-4.));
#149=CARTESIAN_POINT('',(2.5E0,8.,6.));
#150=PLANE('',#151);
#151=AXIS2_PLACEMENT_3D('',#153,$,$);
#152=LINE('',#148,#188);
#153=CARTESIAN_POINT('',(-70.,70.,700.));
#170=STYLED_ITEM('',(#171),#131);
#171=PRESENTATION_STYLE_ASSIGNMENT((#172,#175));
#172=SURFACE_STYLE_USAGE(.NEGATIVE.,#173);
#173=SURFACE_SIDE_STYLE('',(#174));
#174=COLOUR_RGB('inside',0.25,0.00004,1.);
#175=SURFACE_STYLE_USAGE(.POSITIVE.,#176);
#176=SURFACE_SIDE_STYLE('',(#177));
#177=DRAUGHTING_PRE_DEFINED_COLOUR('blue');
#190=PRESENTATION_LAYER_ASSIGNMENT('seen','#102 is only said',(#133,#199,#130));
#199=ADVANCED_FACE('',(),#150,.T.);
"""


@pytest.fixture(scope="module")
def parts(spark):
    files = spark.createDataFrame([("f", bytearray(("X;\nDATA;" + RIG + "ENDSEC;\n").encode()))], "path string, content binary")
    return model.ProductModel(part21.scan(files))


def test_products_and_bodies(parts):
    assert {r.id: r.name for r in parts.products.collect()} == {102: "rig", 110: "plate"}
    assert [tuple(r) for r in parts.bodies.collect()] == [(130, 120, 110)]  # the owned representation, not the other one
    assert [(r.parent, r.child) for r in parts.occurrences.collect()] == [(102, 110)] and [r.id for r in parts.roots.collect()] == [102]
    assert sorted(tuple(r) for r in parts.faces.collect()) == [(130, 132, 131), (130, 133, 131)]


def test_styles_and_boxes(parts):
    style = parts.styles.first()
    assert (style.target, style.surface, style.overriding) == (131, "0.0000,0.0000,1.0000", False)
    assert {r.id: r.key for r in parts.colours.collect()}[174] == "0.2500,0.0000,1.0000"
    assert [tuple(r) for r in parts.face_colours.collect()] == [(130, "0.0000,0.0000,1.0000", 2)]
    assert {(r.owner, r.child): r.orientation for r in parts.uses.collect()}[(144, 145)] == -1
    assert parts.extra_outer_bounds.first().extra == 2
    box = parts.boxes.first()
    assert (box.low, box.high, box.vertices) == ([2.5, 0.0, -4.0], [12.5, 8.0, 6.0], 2)


def test_split(parts):
    rows, membership, ended = parts.split()
    got = {r.id: r.text for r in rows.where("part = 110").collect()}
    assert ended and {101, 110, 111, 112, 113, 114, 120, 130, 131, 132, 133, 170, 190} <= set(got) and not {102, 121, 160, 199} & set(got)
    assert got[190] == "#190=PRESENTATION_LAYER_ASSIGNMENT('seen','#102 is only said',(#133,#130));" and got[174].startswith("#174=COLOUR_RGB")
    again = [r[1] for r in part21.records(("\n" + part21.part_text(rows, "DATA;\n", "\n").first().content).encode())]
    assert sorted(again) == sorted(got) and membership.where("part = 110").count() == len(got)


def test_jobs(spark, parts, tmp_path):
    from refweave.plans import jobs

    (tmp_path / "a.stp").write_text("X;\nDATA;" + RIG + "ENDSEC;\n")
    entities = jobs.read(spark, str(tmp_path / "a.stp"), chunk=200)
    assert entities.count() == parts.entities.count()
    manifest, coverage = jobs.split(entities, str(tmp_path / "out"))
    assert [(r.product, r.name, r.file, r.bodies) for r in manifest.collect()] == [(110, "plate", "plate-110.stp", 1)]
    assert sum(r.in_none + r.in_one + r.in_many for r in coverage.collect()) == entities.count()
    told = jobs.inspect(entities)
    assert told["bodies"].first().n == 1 and told["colours"].first().faces == 2 and sorted(r.dst for r in told["unresolved"].collect()) == [188]
    assert [(r.id, r.depth) for r in told["tree"].orderBy("depth").collect()] == [(102, 0), (110, 1)]
    sha = jobs.checksum(spark, str(tmp_path / "a.stp"))
    jobs.save_index(entities, sha, str(tmp_path / "index"))
    assert jobs.open_index(spark, str(tmp_path / "index"), sha).count() == entities.count() and jobs.open_index(spark, str(tmp_path / "index"), "other") is None


def test_revision_tells_repeated_records_apart(spark):
    from refweave.plans import passes

    schema = "row long, id long, type string, text string, refs array<long>"
    twice = [spark.createDataFrame([(0, k, "P", "x", []), (1, k, "P", "x", [])], schema) for k in (1, 2)]
    assert passes.revision(twice[0]) != passes.revision(twice[1]) and passes.revision(twice[0]) == passes.revision(twice[0].orderBy(F.desc("row")))


def test_passes(spark):
    from refweave.plans import passes

    rows = [(0, 1, "P", "x", []), (1, 2, "P", "x", []), (2, 3, "L", "l", [2, 1, 2]), (3, 4, "Q", "x", [])]
    e = spark.createDataFrame(rows, "row long, id long, type string, text string, refs array<long>")
    plan = passes.plan_sharing(e)
    shared = passes.apply_sharing(e, plan)
    assert {r.id: r.refs for r in shared.collect()} == {1: [], 3: [1, 1, 1], 4: []}
    assert passes.plan_sharing(shared).aliases.count() == 0  # nothing is left to share
    with pytest.raises(ValueError):
        passes.apply_sharing(shared, plan)
    registry = passes.Registry()
    registry.add("share", requires=("resolved",), preserves=("resolved",))(lambda x: passes.apply_sharing(x, passes.plan_sharing(x)))
    out, holds = registry.run(["share", "share"], e, {"resolved", "named"})
    assert out.count() == 3 and holds == {"resolved"}
    with pytest.raises(ValueError):
        registry.run(["share"], e, set())


def test_settings():
    from refweave.plans import settings

    pair = lambda a, b: {"visual": {"linear_deflection_mm": a, "angular_deflection_rad": b}, "collision": {"linear_deflection_mm": a, "angular_deflection_rad": b}}
    preset = {"defaults": pair(4.0, 0.5), "assets": {"floor": pair(2.0, 0.35)}}
    config = {"assets": {"floor": {"visual": {"linear_deflection_mm": 3.0}}}, "parts": {"wall": {"collision": {"angular_deflection_rad": 0.1}}}}
    line = {"visual": {"linear_deflection_mm": 5.0}}
    assert settings.resolve(preset, config, line, "floor")["visual"] == {"linear_deflection_mm": 3.0, "angular_deflection_rad": 0.35}
    assert settings.resolve(preset, config, line, "rune", "wall") == {"collision_mode": "separate", "collision_enabled": True, "visual": {"linear_deflection_mm": 5.0, "angular_deflection_rad": 0.5}, "collision": {"linear_deflection_mm": 4.0, "angular_deflection_rad": 0.1}}
    for bad in ({"colour": 1}, {"visual": {"linear_deflection_mm": True}}, {"visual": {"angular_deflection_rad": 4}}, {"visual": {"x": 1}}, {"collision_enabled": 1}, {"collision_mode": "no"}):
        with pytest.raises(ValueError):
            settings.check_block(bad, "t")
    known = {"field": ({"package", "out"}, {"graft"})}
    stage = {"type": "field", "package": "p", "out": "a/b"}
    assert settings.plan_jobs({"schema_version": 1, "stages": [stage]}, known) == [("field", {"package": "p", "out": "a/b"})]
    for stages in ([stage, stage], [stage, {**stage, "out": "a"}], [{**stage, "type": "x"}], [{"type": "field", "out": "a"}], [{**stage, "y": 1}], []):
        with pytest.raises(ValueError):
            settings.plan_jobs({"schema_version": 1, "stages": stages}, known)
