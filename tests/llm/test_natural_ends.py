"""Pieces end at a natural boundary wherever the piece holds one."""

import os

import pytest

pytest.importorskip("scalarscape.llm")
from scalarscape.llm import splitting, tokenizer  # noqa: E402

needs_vocabulary = pytest.mark.skipif(not os.path.isdir(tokenizer.TOKENIZER_DIR), reason="no vocabularies here")


@needs_vocabulary
@pytest.mark.parametrize("overlap", [0, 6, 20])
def test_a_sentence_end_early_in_a_piece_comes_before_a_word(spark, overlap):
    docs = {1: "One two three four five six seven eight nine ten eleven twelve. " + "word " * 70, 2: "No. " + "word " * 90, 3: "短い。" + "語" * 200}
    d = spark.createDataFrame(list(docs.items()), "doc_id long, text string")
    limits = spark.createDataFrame([("t", 40, overlap)], "limit_name string, max_tokens int, overlap_tokens int")
    rows = sorted(splitting.split(d, limits).collect(), key=lambda r: (r.doc_id, r.piece_no))
    first = {r.doc_id: r for r in rows if r.piece_no == 0}
    assert first[1].boundary == ("sentence" if overlap < 20 else "word") and (overlap == 20 or first[1].text.rstrip().endswith("twelve."))
    assert first[2].boundary == ("sentence" if not overlap else "word")  # an end that leaves too little to share is passed over
    for a, b in zip(rows, rows[1:]):
        if a.doc_id == b.doc_id:
            assert a.start_char < b.start_char <= a.end_char < b.end_char and overlap <= b.overlap_tokens <= overlap + 4
    for r in rows:
        assert r.text == docs[r.doc_id][r.start_char : r.end_char] and len(tokenizer.encode_text(r.text)) == r.n_tokens <= 40
