"""Structured chunking of all documents, those with marks of markdown too."""

import __spark_entry__


def plain_chunks(text):
    """Blanks only: cuts at the first blank from 50 before 400 characters on, and goes back by 20 tokens of 4."""
    out, start = [], 0
    while True:
        rest = text[start:]
        if len(rest) <= 400:
            end = len(rest)
        else:
            end = rest.index(" ", 350)
        out.append(rest[:end])
        tokens = (end + 3) // 4
        hit = rest[:end].find(" ", 4 * (tokens - 20)) if tokens > 20 else -1
        start += end if hit < 0 else hit
        while start < len(text) and text[start] == " ":
            start += 1
        if start >= len(text):
            return out


def test_all_documents_are_chunked(spark, tmp_path):
    marked = "# Title\n\nIntro paragraph.\n\n## Part\n\n- one\n- two"
    long = " ".join(f"word[{i}]" for i in range(300))
    rows = [(1, marked), (2, "a | b and > c # in plain ~ words"), (3, long), (4, "- a single mark")]
    spark.createDataFrame(rows, "doc_id long, text string").write.parquet(str(tmp_path / "documents.parquet"))
    part = "[Context: # Title > ## Part]\n\n"
    first = {
        "chunk_hybrid_documents": ["[Context: # Title]\n\n# Title\n\nIntro paragraph.", f"{part}## Part\n\n- one\n- two"],
        "chunk_markdown_documents": ["[Context: # Title]\n\n# Title", "[Context: # Title]\n\nIntro paragraph.", f"{part}## Part", f"{part}- one\n- two"],
    }
    for name, chunks in first.items():
        got = {}
        for r in __spark_entry__.queries()[name](spark, str(tmp_path)).orderBy("source_id", "chunk_index").collect():
            got.setdefault(r.source_id, []).append(r.content)
        assert got == {1: chunks, 2: [rows[1][1]], 3: plain_chunks(long), 4: [rows[3][1]]}
