"""What must hold for tables that are much larger than a test's: bounded batches, and joins that don't go by a guessed size."""

import pyarrow as pa

import __spark_entry__
from glyphflow.operators import lex as L
from glyphflow.operators import select
from glyphflow.plans.queries_lex import KEYWORDS, WORDS, native

SF = "/root/testdata/sf0.001"
MOST = 1 << 16


def test_tokens_are_placed_in_bounded_parts():
    docs = [["ab", "\n", "é"] * (k % 40) for k in range(5000)] + [["x\ny", " "] * MOST, None, [], ["z"]]
    batch = pa.record_batch([pa.array(range(len(docs)), pa.int64()), pa.array(docs, pa.list_(pa.string()))], ["id", "v"])
    parts = list(L._place([batch, batch.slice(0, 0)]))
    longest = max(len(d or []) for d in docs)
    assert all(p.num_rows <= max(MOST, longest) for p in parts) and sum(p.num_rows > MOST for p in parts) == 1
    got = pa.Table.from_batches(parts)
    alone = pa.Table.from_batches([p for i in range(len(docs)) for p in L._place([batch.slice(i, 1)])])
    assert got.equals(alone) and got.num_rows == sum(len(d or []) for d in docs)
    assert got.slice(got.num_rows - 2).to_pylist()[1] == {"id": len(docs) - 1, "seq": 0, "value": "z", "length": 1, "start_pos": 0, "line": 1, "start_col": 1, "end_col": 2}


def plan(rows):
    return rows._jdf.queryExecution().executedPlan().toString()


def test_a_point_goes_along_with_its_document(spark):
    shown = plan(__spark_entry__.queries()["token_at_offset"](spark, SF))
    assert "Join" not in shown and "hashpartitioning" not in shown
    rows = spark.createDataFrame([(1, 2, 0, 5, "1+2+3"), (1, 2, 2, 1, "2"), (None, 9, 0, 5, "1+2+3")], "doc_id int, offset int, source_start int, source_length int, node_text string")
    assert [tuple(r) for r in select.at_offset(rows, None).collect()] == [(1, 2, 2, 1, "2")]


def test_node_texts_join_without_a_broadcast(spark):
    assert "SortMergeJoin" in plan(__spark_entry__.queries()["select_regex"](spark, SF))
    nodes = spark.createDataFrame([(1, 1, 2), (2, 0, 1), (3, 0, 1)], "doc_id int, source_start int, source_length int")
    rows = select.node_text(nodes, spark.createDataFrame([(1, "aéb"), (2, "x")], "doc_id int, text string"))
    assert "Broadcast" not in plan(rows) and sorted((r["doc_id"], r["node_text"]) for r in rows.collect()) == [(1, "é"), (2, "x")]


def test_hotspots_join_without_a_broadcast(spark):
    rows = __spark_entry__.queries()["graph_hotspots"](spark, SF)
    assert "SortMergeJoin" in plan(rows) and "Broadcast" not in plan(rows)


def test_ranges_need_no_join(spark):
    assert "Join" not in plan(__spark_entry__.queries()["select_range"](spark, SF))


def test_a_document_goes_on_in_the_next_batch():
    docs = [["ab", "\n", "é"] * k for k in range(70)] + [[], ["x\ny\nz", " ", "w"] * 90, ["q"]]
    kind = pa.list_(pa.string())
    whole = pa.Table.from_batches(L._place([pa.record_batch([pa.array(range(len(docs)), pa.int64()), pa.array(docs, kind)], ["id", "v"])]))
    for carried in (1, 4, L.CARRIED):
        runs = [(i, at, d[at : at + carried]) for i, d in enumerate(docs) for at in range(0, len(d), carried)]
        for rows in (1, 3, len(runs)):
            batches = [pa.record_batch([pa.array(x, k) for x, k in zip(zip(*runs[n : n + rows]), (pa.int64(), pa.int32(), kind))], ["id", "at", "v"]) for n in range(0, len(runs), rows)]
            assert pa.Table.from_batches(L._place(batches)).to_pylist() == whole.to_pylist()


def test_rows_to_python_hold_few_tokens(spark):
    docs = spark.createDataFrame([(1, "a1 " * 1000 + "\nb"), (2, ""), (3, None), (4, "c")], "doc_id int, text string")
    for query in ("rename_edits", "tokens_in_range"):
        shown = plan(__spark_entry__.queries()[query](spark, SF))
        assert "Generate explode" in shown[shown.index("MapInArrow") :] and shown.count("regexp_extract_all") == 1
    got = sorted(tuple(r) for r in L.native_tokens(docs, native(WORDS), "doc_id", "text", positions=True).select("doc_id", "seq", "value", "start_pos", "line", "start_col").collect())
    # The last space and the newline are one token.
    assert len(got) == 3002 and got[-3:] == [(1, 2999, " \n", 2999, 1, 3000), (1, 3000, "b", 3001, 2, 1), (4, 0, "c", 0, 1, 1)]


def test_only_the_wanted_tokens_come_back(spark):
    docs = spark.createDataFrame([(1, "of\né of, offof of"), (2, "off"), (3, None), (4, ""), (5, "é " * 900 + "of\n" + "a " * 900 + "of")], "doc_id int, text string")
    own = ["doc_id", "seq", "type", "value"]
    for only in (["of"], ["of", ","], ["é"], ["none"], []):
        for positions, columns in ((True, [*own, "start_pos", "length", "line", "start_col", "end_col"]), (False, own)):
            for mode in ("greedy", "exploratory"):
                whole, part = (sorted(map(tuple, L.lex(docs, KEYWORDS, mode=mode, positions=positions, only=x).select(columns).collect())) for x in (None, only))
                assert part == [t for t in whole if t[3] in only]
    batch = pa.record_batch([pa.array([1, 2, 3]), pa.array([["of", "\n", "x"], ["of"] * 3, ["y"]])], ["id", "v"])
    assert [t["start_pos"] for b in L._place([batch, batch], ["of"]) for t in b.to_pylist()] == [0, 0, 2, 4] * 2
    assert "Contains(text" in plan(__spark_entry__.queries()["rename_edits"](spark, SF)).replace("#", "")


def test_row_groups_of_texts_are_not_held_outside_the_heap_too(spark):
    from glyphflow.plans.catalog import texts

    read = texts(spark, SF, "documents")._jdf.queryExecution().optimizedPlan().collectLeaves().head().relation().options()
    assert read.get("parquet.hadoop.vectored.io.enabled").get() == "false"


def test_the_general_lexer_gives_out_rows_in_bounded_parts():
    taken = []
    rows = ((0, (taken.append(k), k)) for k in range(3 * L.GATHERED + 1))
    parts = L._gathered(rows)
    ids, columns = next(parts)
    assert len(ids) == len(taken) == L.GATHERED
    assert [len(i) for i, _ in parts] == [L.GATHERED] * 2 + [1]
