"""Characters at the cuts of the suffix stage."""

import corpus_pipeline as pipeline
from cadenza.llm import suffix_dedup


def test_split_characters_go_and_others_stay():
    for text in ("a\ufffdé☃🙂", "\ufffd", "🙂é", "ab", ""):
        raw = text.encode()
        for a in range(len(raw) + 1):
            for b in range(a, len(raw) + 1):
                due = "".join(c for i, c in enumerate(text) if len(text[:i].encode()) >= a and len(text[: i + 1].encode()) <= b)
                got = suffix_dedup.whole_characters(raw[a:b], True, True).decode()
                assert got == due, (text, a, b)
        assert suffix_dedup.whole_characters(raw, False, False) == raw


def test_genuine_replacement_characters_stay(spark):
    same = "".join(f"{i} is a number; " for i in range(40))
    texts = {1: "one \ufffd mark \ufffd", 2: f"x\ufffd🙂{same}", 3: f"y\ufffd\U0001f602{same}\ufffd", 4: None}
    docs = spark.createDataFrame([(k, t, k) for k, t in texts.items()], "doc_id long, text string, n_chars long")
    got = {r.doc_id: (r.text, r.n_chars) for r in pipeline.suffix_array_dedup(spark, docs, "").collect()}
    # the second and third text share all bytes from the last one of their emoji on
    due = {1: texts[1], 2: texts[2], 3: "y\ufffd\ufffd", 4: ""}
    assert got == {k: (t, len(t)) for k, t in due.items()}
