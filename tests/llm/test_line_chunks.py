"""Every line of a text of several lines is in a chunk that is searched for copies."""

from corpusloom.llm import line_dedup


def test_no_chunk_of_one_line():
    for n in range(2, 60):
        text = "\n".join(f"row {n} {i * i}" for i in range(n))
        cut = line_dedup.chunks(text)
        assert b"\n".join(x for c in cut for x in c) == text.encode() and min(map(len, cut)) >= line_dedup.MIN_LINES
    assert line_dedup.chunks("one line") == [[b"one line"]] and line_dedup.chunks(None) == [[b""]]


def test_whole_copies_go(spark):
    texts = ["\n".join(f"row {k} {i * i}" for i in range(k)) for k in range(2, 30)]
    got = line_dedup.remove_repeated_chunks(spark.createDataFrame(list(enumerate(texts * 2)), "doc_id long, text string")).collect()
    assert all(r["n_removed_lines"] == (r["n_lines"] if r["doc_id"] >= len(texts) else 0) for r in got)
