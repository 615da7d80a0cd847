"""Catalog, search, ranking and questions on fixtures that can be checked by hand."""

import json
import math

import pytest
from pyspark.sql import functions as F

from ledgerlight.functions import text as T
from ledgerlight.operators import catalog, questions, ranking, search
from ledgerlight.operators.search import Constraint
from ledgerlight.sources import files, fingerprint


def one(spark, column):
    return spark.range(1).select(column.alias("x")).first()["x"]


def test_text_functions(spark):
    assert one(spark, T.normalize_text(F.lit("ﬁ  Straße "))) == "fi strasse"
    assert one(spark, T.match_key(F.lit("material: alloy / tin"))) == "material:alloy/tin"
    assert one(spark, T.ngrams(T.ordered_tokens(F.lit("A b-c a")), 2)) == ["a b", "b c", "c a"]
    assert one(spark, T.ngrams(T.ordered_tokens(F.lit("one")), 2)) == []
    assert one(spark, T.coarse_category(F.array(F.lit("Clothing, Men"), F.lit("Shoes, Boots")))) == "Shoes Boots"
    got = [one(spark, T.classify_constraint(F.lit(x))) for x in ("under 40", "soft wool", "color: teal", "wide", "long sleeve", "for running", "zip")]
    assert got == ["budget", "material", "color", "size", "style", "use_case", "feature"]
    cid = F.lit("t3:budget:less_than_or_equal:a:b-c:include:7")
    assert one(spark, T.parse_constraint_id(cid))["value"] == "a:b c"
    assert one(spark, T.parse_constraint_id(cid, legacy=True))["value"] == "a"


def test_numbers(spark):
    assert [one(spark, catalog.optional_float(F.lit(x))) for x in ("1.5", "NaN", "inf", "from 3", "")] == [1.5, None, None, None, None]
    assert one(spark, catalog.non_negative_int(F.lit(None).cast("string"), "n")) == 0
    with pytest.raises(Exception, match="not a count"):
        one(spark, catalog.non_negative_int(F.lit("-1"), "n"))
    assert one(spark, catalog.wilson_prior(F.lit(None).cast("double"), F.lit(3))) == 0.0
    p, n, z = 0.9, 10, 1.96
    want = (p + z * z / (2 * n) - z * math.sqrt((p * (1 - p) + z * z / (4 * n)) / n)) / (1 + z * z / n)
    assert one(spark, catalog.wilson_prior(F.lit(4.5), F.lit(10))) == pytest.approx(want)


def test_material_and_keyed_recovery(spark):
    got = [one(spark, catalog.feature_material_tokens(F.lit(x))) for x in ("100% Leather", "faux leather", "leather sole", "60% cotton, 40% wool")]
    assert got == [["leather"], ["leather"], ["sole"], ["cotton", "wool"]]
    pair = one(spark, catalog.keyed_value(F.lit("Colour: Black; material: polyester")))
    assert (pair["attribute"], pair["value"]) == ("color", "black")
    assert one(spark, catalog.keyed_value(F.lit("note: x"))) is None


def rows(spark):
    return spark.createDataFrame(
        [(i, ["red", "blue"][i % 2], ["S", "M", "L"][i % 3], None if i == 5 else 10.0 * i, i / 20) for i in range(12)],
        "id long, color string, size string, price double, quality_prior double",
    )


def test_hard_filters(spark):
    items = rows(spark)
    eav = catalog.attributes(items, scalars={"color": "color", "size": "size"})
    ids = lambda *c: sorted(r["id"] for r in search.hard_filter(items, eav, list(c)).collect())
    assert ids(Constraint("color", "red"), Constraint("size", "S", excluded=True)) == [2, 4, 8, 10]
    assert ids(Constraint("budget", "30", "less_than_or_equal")) == [0, 1, 2, 3]
    assert 5 in ids(Constraint("budget", "30", "less_than_or_equal", excluded=True))
    with pytest.raises(ValueError):
        Constraint("color", "red", confidence=0.5)
    assert [r["id"] for r in search.quality_topk(items, 3).orderBy("rank").collect()] == [11, 10, 9]
    assert search.quality_topk(items, 3, work_limit=2).count() == 0


def test_bm25_against_sqlite(spark):
    sqlite3 = pytest.importorskip("sqlite3")
    db = sqlite3.connect(":memory:")
    docs = [(i, " ".join(["boot", "winter", "red", "sole"][: 1 + i % 4] * (1 + i % 3)), "warm boot" if i % 5 == 0 else "x y") for i in range(30)]
    try:
        db.execute("create virtual table t using fts5(a, b)")
    except sqlite3.OperationalError:
        pytest.skip("no fts5")
    db.executemany("insert into t(rowid, a, b) values (?, ?, ?)", docs)
    want = dict(db.execute("select rowid, -bm25(t, 6.0, 1.5) from t where t match 'winter OR sole OR warm'").fetchall())
    df = spark.createDataFrame(docs, "id long, a string, b string")
    got = {r["id"]: r["score"] for r in search.bm25(df, {"a": 6.0, "b": 1.5}, ["winter", "sole", "warm"]).collect()}
    assert got == pytest.approx(want)


def test_plans_and_relaxations():
    cs = [Constraint("color", "red boots", id="a"), Constraint("style", "x", strength="soft", confidence=0.8, id="b"), Constraint("brand", "q", excluded=True, id="c"),
          Constraint("size", "m", id="d", evidence="clarification_answer")]
    plans = search.strict_plans(cs)
    assert [p.route for p in plans] == ["metadata"] * 3 + ["exact_fts", "expanded_fts", "category_fallback"]
    assert "footwear" in plans[-2].terms
    assert [c.id for c in search.relaxation_order(cs, 0, 10)] == ["d", "a"]
    assert [c.id for c in search.relaxation_order(cs, 3, 10)] == ["d"]
    assert search.relaxation_order(cs, 10, 10) == []
    assert [p.relaxed for p in search.counterfactual_plans(cs, search.relaxation_order(cs, 0, 10))] == ["d", "a"]


def test_gate_posterior_and_slate(spark):
    items = rows(spark)
    cols = {"color": F.array("color"), "size": F.array("size")}
    gate = ranking.eligibility_reasons([Constraint("color", "re", id="c"), Constraint("budget", "50", "less_than_or_equal", id="p")], cols, F.col("price"))
    got = {r["id"]: r["g"] for r in items.select("id", gate.alias("g")).collect()}
    assert got[0] == [] and got[1] == ["c"] and got[5] == ["c", "p"] and got[6] == ["p"]
    even = ranking.posterior(items.withColumn("log_belief", F.lit(1.0)))
    assert {round(r["posterior"], 12) for r in even.collect()} == {round(1 / 12, 12)}
    pool = items.select("id", F.col("quality_prior").alias("posterior"), F.lit(0.0).alias("score"), (F.col("id") < 3).alias("exploratory"), (F.col("id") == 11).alias("shown"))
    assert [r["id"] for r in ranking.slate(pool, 12).orderBy("position").collect()] == [10, 9, 8, 7, 6, 5, 4, 3, 11, 0, 1, 2]
    relaxed = spark.createDataFrame([(i, 1) for i in (3, 4)] + [(i, 2) for i in (5, 6)], "id long, ordinal int")
    filled = ranking.fill_tail(spark.createDataFrame([(1,), (2,)], "id long"), relaxed, 4)
    assert sorted(r["id"] for r in filled.collect()) == [1, 2, 3, 4]


def test_question_model(spark):
    pool = spark.createDataFrame([(i, 0.25, ["red", "blue", "green", "grey"][i], "M", None) for i in range(4)], "id long, posterior double, color string, size string, style string")
    got = {r["attribute"]: r for r in questions.question_scores(pool, ["color", "size", "style"]).collect()}
    assert got["color"]["current_entropy"] == pytest.approx(2.0)
    p = [0.95 / 1.1, *[0.05 / 1.1] * 3]
    gain = 0.85 * (2 - -sum(x * math.log2(x) for x in p))
    assert got["color"]["information_gain"] == pytest.approx(gain) and got["color"]["score"] == pytest.approx(0.95 * gain - 0.05)
    assert got["size"]["information_gain"] == pytest.approx(0.0, abs=1e-9) and got["style"]["score"] == pytest.approx(-0.05)
    scores = questions.question_scores(pool, ["color", "size", "style"])
    assert questions.choose_question(scores, [], 1).first()["attribute"] == "color"
    assert questions.choose_question(scores, ["color"], 1).count() == 0 and questions.choose_question(scores, [], 10).count() == 0


def test_catalog_artifacts(spark, tmp_path):
    boots = [
        {"parent_asin": f"B{i}", "title": "Winter  BOOT", "features": ["100% leather", "Color: black", ""], "categories": ["Shoes"], "details": {"Material": "Leather"}, "description": ["warm", "dry"],
         "store": "Acme", "average_rating": 4.5, "rating_number": 10, "price": 20.0 if i else None}
        for i in range(3)
    ]
    path = tmp_path / "catalog.jsonl"
    path.write_text("\n".join(map(json.dumps, boots)) + "\n\n")
    target = f"file://{tmp_path}/artifacts"
    manifest = files.build_artifacts(spark, f"file://{path}", target)
    assert manifest["products"] == 3
    found = files.open_artifacts(spark, target)
    first = found["products"].where("id = 'B0'").first()
    assert first["title"] == "winter boot" and first["features"] == ["100% leather", "color: black"] and first["price"] is None
    assert first["searchable_text"] == "winter boot shoes 100% leather color: black material leather acme warm dry"
    eav = {(r["attribute"], r["value"]) for r in found["attributes"].where("id = 'B1'").collect()}
    assert eav == {("category", "shoes"), ("feature", "100% leather"), ("feature", "color: black"), ("brand", "acme"), ("budget", "20.0"), ("material", "leather"), ("color", "black")}
    weights = {r["term"]: r["weighted_frequency"] for r in found["postings"].where("id = 'B1'").collect()}
    assert weights["boot"] == 6.0 and weights["leather"] == 5.0 and weights["acme"] == 1.5
    assert found["terms"].where("term = 'boot'").first()["document_frequency"] == 18
    with pytest.raises(FileExistsError):
        files.build_artifacts(spark, f"file://{path}", target)
    files.open_artifacts(spark, target, f"file://{path}", deep=True)
    path.write_text(path.read_text().replace("Acme", "Acne"))
    with pytest.raises(ValueError, match="catalog has changed"):
        files.open_artifacts(spark, target, f"file://{path}")
    path.write_text("\n".join(map(json.dumps, [boots[0], boots[0]])))
    with pytest.raises(ValueError, match="repeated"):
        files.build_artifacts(spark, f"file://{path}", f"file://{tmp_path}/other")
    assert sorted(p.name for p in tmp_path.iterdir() if p.is_dir()) == ["artifacts"]


def test_artifacts_of_other_rows_or_files_are_refused(spark, tmp_path):
    path, target = tmp_path / "catalog.jsonl", tmp_path / "artifacts"
    path.write_text("\n".join(json.dumps({"parent_asin": f"B{i}", "title": f"boot {i}", "store": "Acme"}) for i in range(20)))
    files.build_artifacts(spark, f"file://{path}", f"file://{target}")
    found = files.open_artifacts(spark, f"file://{target}")
    other = found["terms"].withColumn("document_frequency", F.col("document_frequency") + (F.col("term") == "acme").cast("int")).collect()
    schema = found["terms"].schema
    before = {p: p.read_bytes() for p in (target / "terms").glob("part*")}
    lost = sorted(before)[0]
    lost.unlink()
    with pytest.raises(ValueError, match="files of terms"):
        files.open_artifacts(spark, f"file://{target}")
    spark.createDataFrame(other, schema).coalesce(1).write.mode("overwrite").parquet(f"file://{target}/terms")
    (text,) = (target / "manifest").glob("part*")
    manifest = json.loads(text.read_text())
    manifest["relations"]["terms"]["bytes"] = fingerprint.files(spark, f"file://{target}/terms")  # as if a changed byte left the sizes alone
    for p in (target / "manifest").glob(".*.crc"):
        p.unlink()
    text.write_text(json.dumps(manifest))
    files.open_artifacts(spark, f"file://{target}")
    with pytest.raises(ValueError, match="rows of terms"):
        files.open_artifacts(spark, f"file://{target}", deep=True)


def test_details_of_any_depth(spark, tmp_path):
    deep = {"A  Key": {"inner": ["Ｏne", {"x": None, "y": 'two "q" words'}, 3]}, "Plain": " Stra\u00dfe ", "Empty": "", "None": None}
    path = tmp_path / "c.jsonl"
    path.write_text(json.dumps({"parent_asin": "  B1\t", "title": "x", "details": deep}))
    row = files.read_catalog(spark, f"file://{path}").first()
    assert row["id"] == "B1" and ("plain", "strasse") in [tuple(d) for d in row["details"]] and len(row["details"]) == 2
    assert row["searchable_text"] == 'x a key inner one x y two "q" words 3 plain strasse'


def test_fingerprints_do_not_depend_on_partitions_or_order(spark):
    rows = spark.range(500).select("id", F.array(F.struct(F.lit(1).alias("b"), F.col("id").alias("a"))).alias("x"), F.when(F.col("id") % 3 > 0, "t").alias("t"), F.create_map(F.lit("k"), F.col("id"), F.lit("a"), F.lit(1)).alias("m"))
    one, other = fingerprint.fingerprint(rows.coalesce(1)), fingerprint.fingerprint(rows.select("m", "t", "x", "id").repartition(7).orderBy(F.col("id").desc()))
    assert one == other and one["rows"] == 500 and fingerprint.drift(rows, one) == []
    changed = rows.withColumn("t", F.when(F.col("id") == 77, "u").otherwise(F.col("t")))
    assert fingerprint.fingerprint(changed)["digest"] != one["digest"] and 1 <= len(fingerprint.drift(changed, one)) <= 2
    assert fingerprint.fingerprint(rows.union(rows.where("id = 5")))["digest"] != one["digest"]
    assert fingerprint.fingerprint(rows.limit(0))["rows"] == 0
    assert fingerprint.request_digest({"b": 1, "a": "é"}) == fingerprint.request_digest({"a": "é", "b": 1})
