"""What rides along with pairs, and how often texts are read."""

import random

from pyspark.sql import functions as F

from corpusloom.functions import text
from corpusloom.llm import license_scan
from corpusloom.operators import candidates as cand
from corpusloom.operators import packet
from corpusloom.plans.catalog import QUERIES

LEAN = (
    "request_id string, source string, candidate_type string, relevance double, semantic double, freshness double, confidence double, importance double, "
    "final_score double, is_hot boolean, n_deps int, size int, clip_floor int, content_key string, flags int"
)


def _rows(spark, *rows):
    made = [(r, s, "artifact", rel, 0.0, 0.5, 0.5, 0.5, score, False, 0, 10, 10, key, 0) for r, s, rel, score, key in rows]
    return spark.createDataFrame(made, LEAN)


def _plan(frame):
    return frame._jdf.queryExecution().optimizedPlan().toString()


def test_hints_meet_texts_once_a_list_and_keep_the_rows_of_repeated_sources(spark):
    scored = _rows(
        spark, ("r1", "a", 0.1, 0.5, "k"), ("r1", "b", 0.1, 0.5, "k"), ("r1", "b", 0.1, 0.5, "k"), ("r1", "c", 0.1, 0.5, "k"), ("r1", "c", 0.1, 0.5, "k"),
        ("r2", "a", 0.2, 0.5, "k"), ("r3", "b", 0.2, 0.5, "k"),
    )
    texts = spark.createDataFrame(
        [("a", "The end", []), ("b", "the hat", []), ("b", "the hat", []), ("c", "no", []), ("c", "no", [])], "source string, content string, dependencies array<string>"
    )
    hints = spark.createDataFrame([("r1", ["x"], [" The ", "zz"]), ("r2", [], [])], "request_id string, priority_sources array<string>, include_terms array<string>")
    got = cand.apply_hints(scored, hints, texts)
    assert "content#" not in _plan(got)  # pairs are joined with shares, not with texts
    shown = sorted((r["request_id"], r["source"], r["relevance"]) for r in got.collect())
    # As a join of candidates, hits and texts on the source gives them: n candidates with n texts are n * n * n rows.
    assert shown == sorted([("r1", "a", 0.475)] + [("r1", "b", 0.475)] * 8 + [("r1", "c", 0.1)] * 8 + [("r2", "a", 0.2), ("r3", "b", 0.2)])


def test_relationship_graph_runs_its_patterns_once(spark, tmp_path):
    docs = [(n, f"import mod{n % 2}\nfrom emitter import x\n", "en", "s", 10) for n in range(6)] + [(6, None, "de", "s", 0)]
    spark.createDataFrame(docs, "doc_id long, text string, lang string, source string, n_chars long").write.parquet(f"{tmp_path}/documents.parquet")
    got = QUERIES["relationship_graph"](spark, str(tmp_path))
    assert "regexp_extract_all" not in _plan(got)
    counts = {r["what"]: r["n"] for r in got.collect()}
    assert counts["related_to"] == 7 and counts["emits"] == 6 and counts["map"] == counts["emits"] + counts["uses"]


def test_best_candidates_carry_what_is_asked_for(spark):
    scored = _rows(spark, ("r", "b", 0.1, 0.5, "k"), ("r", "a", 0.1, 0.5, "k"), ("r", "c", 0.1, 0.9, "l"), ("r", "d", 0.1, 0.0, "m"))
    lean = cand.dedup_candidates(scored, keep=("source", "final_score"))
    assert lean.columns == ["request_id", "candidate_type", "content_key", "source", "final_score"] and "min_by" not in _plan(lean)
    assert sorted((r["source"], r["final_score"]) for r in lean.collect()) == [("a", 0.5), ("c", 0.9), ("d", 0.0)]
    assert sorted(cand.dedup_candidates(scored).columns) == sorted(cand.LEAN_COLUMNS)


def test_dependency_lists_are_no_keys(spark):
    scored = _rows(spark, ("r1", "a", 0.1, 0.5, "k"), ("r1", "b", 0.1, 0.5, "k"), ("r2", "b", 0.1, 0.5, "k"), ("r2", "c", 0.1, 0.5, "k"))
    docs = spark.createDataFrame([("a", [" ost ", "sys"]), ("b", ["sys", "x"]), ("c", []), ("c", None)], "source string, dependencies array<string>")
    got = packet.candidate_dependencies(scored, docs)
    assert sorted(map(tuple, got.collect())) == [("r1", "ost"), ("r1", "sys"), ("r2", "sys")]
    assert "Aggregate [request_id" in _plan(got) and ", list#" not in _plan(got).split("Aggregate [", 1)[1].split("]", 1)[0]
    assert _plan(got).count("Aggregate [") == 1  # none by list in between


def test_content_key_of_long_texts_is_that_of_the_whole(spark):
    texts = [" \n Word" * 400, "x" * 5000, " " * 3000 + "End  of\tit" * 100, "a" + "\n" * 4000 + "b", "", "short  One", None]
    frame = spark.createDataFrame([(t,) for t in texts], "content string")
    whole = F.md5(F.substr(text.squeeze(F.col("content")), F.lit(1), F.lit(420)))
    assert all(r["content_key"] == r["w"] for r in cand.with_content_profile(frame).withColumn("w", whole).collect())


def test_strip_drops_what_the_pattern_drops(spark):
    rng = random.Random(4)
    pool = [*map(chr, range(1, 0x21)), "\x85", "\xa0", " ", "᠎", " ", " ", "​", " ", " ", " ", " ", "　", "﻿", "a", "é"]
    made = ["".join(rng.choices(pool, k=rng.randrange(9))) for _ in range(800)]
    frame = spark.createDataFrame([(t,) for t in [*made, *pool, None]], "t string")
    assert frame.filter(~text.strip(F.col("t")).eqNullSafe(F.regexp_replace("t", r"(?U)^\s+|\s+$", ""))).count() == 0


def test_licence_tokens_and_known_grams_are_those_of_the_plain_rules(spark):
    rng = random.Random(5)
    made = ["".join(rng.choices("aB1.. -\ré", k=rng.randrange(14))) for _ in range(800)] + ["..a..b.c. ", "v. 2.0.", "a." * 5000, "", None]
    frame = spark.createDataFrame([(t,) for t in made], "t string")
    plain = F.filter(F.split(F.regexp_replace(F.lower("t"), r"[^a-z0-9.]+|[.]+(?=[^a-z0-9]|$)", " "), " "), lambda w: w != "")
    assert frame.filter(~license_scan.tokens(F.col("t")).eqNullSafe(plain)).count() == 0
    known = frame.limit(0).sparkSession.range(1).select(license_scan.known_grams(F.array(*map(F.lit, ["b", "a", "b", "a", "c", "b"])), ["a", "b", "a b", "c a", "b d"]).alias("h"))
    assert known.first()["h"] == ["b", "a", "a b"]
