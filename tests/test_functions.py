"""Text functions, sources, statistics and models."""

import math
import random

import numpy as np
import pytest
from pyspark.sql import functions as F

from glyphflow import sources
from glyphflow.functions import text as X
from glyphflow.grammar import read_grammar
from glyphflow.ml import features, train
from glyphflow.operators import grammar_relations, lex, parse, pattern_scan, stats
from glyphflow.rules import compile_rule


def one(spark, column):
    return spark.range(1).select(column.alias("x")).first()["x"]


def test_encodings(spark, tmp_path):
    assert one(spark, X.convert(F.unhex(F.lit("E9")), "latin-1")) == "é" and one(spark, X.convert(F.unhex(F.lit("80")), 1252)) == "€"
    assert X.encoding_available("utf-16") and X.encoding_available(1252) and not X.encoding_available("none") and "utf-8" in X.available_encodings()
    with pytest.raises(ValueError, match="unknown encoding"):
        X.convert(F.lit(b""), "none")
    with pytest.raises(ValueError, match="form"):
        X.normalize(F.lit(""), "NFX")
    (tmp_path / "a.txt").write_bytes(b"\xff\xfe" + "é\n".encode("utf-16-le"))
    (tmp_path / "b.txt").write_bytes(b"\xef\xbb\xbfabc\xff")
    got = {r["file_name"].rsplit("/", 1)[1]: (r["text"], r["n_bytes"]) for r in sources.from_files(spark, str(tmp_path)).collect()}
    assert got == {"a.txt": ("é\n", 3), "b.txt": ("abc�", 6)}


def test_sources_and_sinks(spark, tmp_path):
    rows = sources.from_strings(spark, ["é", "", None], ["x", "y", "z"])
    assert [tuple(r) for r in rows.orderBy("doc_id").collect()] == [("0", "x", "é", 2), ("1", "y", "", 0), ("2", "z", None, 0)]
    same = sources.from_column(rows, "text", "doc_id", "file_name")
    assert same.columns == sources.SOURCE_COLUMNS
    tokens = lex.general_tokens(rows, [compile_rule("l", r"/\p{L}/")], "doc_id", "text")
    for form in ("parquet", "json", "csv"):
        sources.write(tokens, str(tmp_path / form), form)
        assert spark.read.format(form).load(str(tmp_path / form)).count() >= 1


def test_text_functions(spark):
    assert one(spark, X.code_points(F.lit("aé😀"))) == [97, 233, 128512]
    assert one(spark, X.grapheme_starts(F.lit("aé"))) == [0, 1] and one(spark, X.grapheme_starts(F.lit(""))) == []
    assert one(spark, X.valid_code_points(F.lit("a"))) and not one(spark, X.valid_code_points(F.lit("a�")))
    assert [tuple(r) for r in one(spark, X.hex_escapes(F.lit(r"\x41\x{1F600}\x{zz}\x4")))] == [(r"\x41", 65), (r"\x{1F600}", 128512)]
    assert one(spark, X.normalize(F.lit("ﬁ"), "NFKC")) == "fi" and one(spark, X.normalize(F.lit(None).cast("string"))) is None
    assert one(spark, X.has_property(F.ascii(F.lit("α")), "Greek")) and not one(spark, X.has_property(F.ascii(F.lit("a")), "Nope"))
    assert one(spark, X.has_category(F.lit("ß"), "LC")) and one(spark, X.ascii_class(F.lit("é"))) == "non-ascii"


def test_pattern_scan_of_text_and_column_agree(spark):
    patterns = [r"a+?b", r"[^\]x]{2}(?i)\p{Lu}", r"\Qa.b\E|^$", r"(?#n(o)te)(\d+)\.", r"\x{41}", "é*", ""]
    rows = spark.createDataFrame(list(enumerate(patterns)), "id int, pattern string")
    got = pattern_scan.scan(rows, "id", "pattern").orderBy("id", "start").collect()
    for i, p in enumerate(patterns):
        assert [r["type"] for r in got if r["id"] == i] == [k for k, _ in pattern_scan.scan_text(p)]
    best = pattern_scan.disambiguate(pattern_scan.scan(rows, "id", "pattern")).where("id = 4 AND seq = 0").first()
    assert (best["type"], best["text"]) == ("UnicodeEscape", r"\x{41}")
    assert one(spark, pattern_scan.is_inline_modifier(F.lit("(?ims)"))) and not one(spark, pattern_scan.is_inline_modifier(F.lit("(?z)"))) and pattern_scan.property_is_known("Lu")


def test_lex_chooses_its_plan(spark):
    docs = spark.createDataFrame([(1, "if x1\n  ify"), (2, None), (3, "@")], "doc_id int, text string")
    easy = [compile_rule("IF", "'if'", 9, 0), compile_rule("ID", "/[a-z]+/", 0, 1), compile_rule("N", "/[0-9]+/", 0, 2), compile_rule("WS", r"/[ \n]+/", 0, 3, skippable=True)]
    native = lex.lex(docs, easy, positions=True).drop("seq")
    # Tokens are made in the JVM; their places are summed in Arrow batches, and neither is shuffled.
    assert "MapInArrow" not in lex.lex(docs, easy)._jdf.queryExecution().toString()
    plan = native._jdf.queryExecution().executedPlan().toString()
    assert "regexp_extract_all" in plan and "Exchange" not in plan
    general = lex.general_tokens(docs, easy, "doc_id", "text", "greedy").select(*native.columns)
    assert sorted(map(tuple, native.collect())) == sorted(map(tuple, general.collect()))
    odd = spark.createDataFrame([(1, "é\n\nß x\n"), (2, ""), (3, "x\n\n\n"), (4, None), (5, "\n"), (6, "zé")], "doc_id int, text string")
    wide = [compile_rule("L", r"/\p{L}+/", 0, 0), compile_rule("S", r"/[ \n]+/", 0, 1)]
    found = lex.lex(odd, wide, positions=True).drop("seq")
    assert sorted(map(tuple, found.collect())) == sorted(map(tuple, lex.general_tokens(odd, wide, "doc_id", "text", "greedy").select(*found.columns).collect()))
    hard = [compile_rule("AB", "/a|ab/", 0, 0)]
    assert "MapInArrow" in lex.lex(docs, hard)._jdf.queryExecution().toString()
    assert "Exchange" not in lex.lex(docs, easy)._jdf.queryExecution().toString()
    assert [r["value"] for r in lex.lex(spark.createDataFrame([(1, "aab")], "doc_id int, text string"), hard).orderBy("seq").collect()] == ["a", "ab"]
    assert lex.lex_paths(docs, hard, "doc_id", "text").count() >= 2


def test_labels_and_training(spark):
    rng = np.random.default_rng(1)
    x = rng.normal(size=(3000, 2))
    y = (rng.random(3000) < 1 / (1 + np.exp(-(0.5 + 2 * x[:, 0] - x[:, 1])))).astype(int)
    rows = spark.createDataFrame([(i, [1.0, float(a), float(b)], int(c)) for i, ((a, b), c) in enumerate(zip(x, y, strict=True))], "seq long, features array<double>, label int")
    learn, held = train.hold_out(rows, "seq")
    w = train.train(learn)
    assert held.count() == 600 and np.allclose(w, [0.5, 2, -1], atol=0.25)
    m = train.evaluate(held.withColumn("probability", 1 / (1 + F.exp(-train._z(w, 3))))).first()
    assert m["auc"] > 0.85 and m["accuracy"] > 0.75 and m["log_loss"] < 0.5 and train.train(rows.limit(0)) == []
    grammar = read_grammar("<a> ::= 'x'\n<s> ::= <a> <s> | <s> <a> | <a> <a> <s> | <a>")
    labels = parse.path_labels(spark.createDataFrame([(1, "x" * 12)], "doc_id int, text string"), grammar)
    assert labels.where(F.size("features") != 6).count() == 0


def test_models_as_columns_and_switches(monkeypatch):
    rule = compile_rule("n", "/[0-9]+/")
    assert features.rule_probability(rule, ord("7")) == pytest.approx(1 / (1 + math.exp(-(-0.3 + 1.5 + 0.1))))
    s = features.Switch()
    s.enable("path_pruning", "0.2.0")
    assert s.is_enabled("path_pruning") and "0.2.0" in s.status() and not s.is_enabled("rule_prioritization")
    monkeypatch.setenv(features.DISABLE_ALL, "true")
    assert not s.is_enabled("path_pruning")
    s.disable("path_pruning")
    with pytest.raises(ValueError, match="unknown"):
        s.enable("none")


def test_statistics(spark):
    rng = random.Random(3)
    rows = spark.createDataFrame([(float(n), 3.0 * n + 5, 2.0 * n**0.5 * rng.choice([1.0])) for n in range(1, 50)], "x double, y double, z double")
    fit = stats.linear_fit(rows, "y", "x").first()
    assert (round(fit["slope"], 6), round(fit["intercept"], 6), round(fit["r2"], 6)) == (3.0, 5.0, 1.0) and fit["growth"] == pytest.approx((3 * 49 + 5) / 49 / 8)
    assert stats.scaling_exponent(rows, "z", "x").first()["exponent"] == pytest.approx(0.5) and stats.pearson(rows, "x", "y").first()["r"] == pytest.approx(1)
    status = spark.createDataFrame([(10, 4), (0, 0)], "attempts long, wasted long")
    assert stats.wasted_ratio(status).first()["ratio"] == 0.4
    with pytest.raises(ValueError, match="policy"):
        grammar_relations.overlay_tokens(rows, rows, "None")
