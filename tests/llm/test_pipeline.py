"""The pipeline's stages, each against a plain version on its own input."""

from __future__ import annotations

import sys
import zlib
from pathlib import Path

sys.path.insert(0, str(Path(__file__).parent))

from test_brute import DATA, plain_overlaps
from test_small import brute_components, documents

import corpus_pipeline
from docgrowth.llm import langid, pii, stages, tokens
from docgrowth.llm.queries import tokenizer_file
from docgrowth.llm.tables import table


def texts_of(df):
    return {r["doc_id"]: r["text"] for r in df.collect()}


def test_stages_one_after_another(spark):
    docs, columns = table(spark, DATA, "documents"), table(spark, DATA, "documents").columns
    names = [n for n, _ in corpus_pipeline.STAGES]
    assert names == ["language", "near_copies", "decontamination", "personal_data", "packing"]
    before = texts_of(docs)
    for name, stage in corpus_pipeline.STAGES[:-1]:
        result = stage(spark, docs, DATA)
        assert result.columns == columns
        docs = stages.written(result, name)
        after = texts_of(docs)
        if name == "language":
            model = langid.fit(table(spark, DATA, "documents"))
            said = {r["doc_id"]: r["language"] for r in langid.predict(table(spark, DATA, "documents"), model, near=0.02).collect()}
            want = {i: t for i, t in before.items() if said[i]["lang_pred"] != "und" and not said[i]["ambiguous"]}
            assert len(want) > 0.9 * len(before)
        elif name == "near_copies":
            want = {i: before[i] for i, c in brute_components(before).items() if i == c}
            assert len(want) < len(before)
        elif name == "decontamination":
            items = {r["item_id"]: r["text"] for r in table(spark, DATA, "benchmark").collect()}
            met = {i for i, _ in plain_overlaps(before, items)}
            want = {i: t for i, t in before.items() if i not in met}
            assert met
        else:
            want = {}
            for i, t in before.items():
                spans, at, out = sorted((s, -e, k) for k, v in pii.all_spans(t)[1].items() for s, e in v), 0, ""
                for s, e, k in spans:
                    if s >= at:
                        out += t[at:s] + f"<{k.upper()}>"
                    at = max(at, -e)
                want[i] = out + t[at:]
            assert want != before and all(r["n_chars"] == len(r["text"]) for r in docs.collect())
        assert after == want
        before = after
    encode = tokens.Encoder(tokenizer_file()).tokenizer
    pieces = corpus_pipeline.packing(spark, docs, DATA).collect()
    for i, t in before.items():
        ids = [*encode.encode(t, add_special_tokens=False).ids, 1]
        raw = b"".join(x.to_bytes(4, "little") for x in ids)
        own = sorted((r["piece"], r["start"], r["length"], r["ids_crc32"]) for r in pieces if r["doc_id"] == i)
        assert own == [(k, 4096 * k, len(p) // 4, zlib.crc32(p)) for k, p in enumerate(raw[s : s + 16384] for s in range(0, len(raw), 16384))]
    fill: dict = {}
    for r in pieces:
        fill.setdefault(r["sequence_id"], []).append((r["offset"], r["length"]))
    for parts in fill.values():
        at = 0
        for offset, n in sorted(parts):
            assert offset == at
            at += n
        assert at <= 4096
    whole = corpus_pipeline.run(spark, DATA).collect()
    assert sorted((r["doc_id"], r["piece"], r["ids_crc32"]) for r in whole) == sorted((r["doc_id"], r["piece"], r["ids_crc32"]) for r in pieces)


def test_stages_of_hard_rows(spark):
    rows = [(1, None, "en"), (2, "", "en"), (3, "½ 12", None), (4, "plain words in a row that say little", "en"), (4, "plain words in a row that say little", "en"), (None, "one more text of words", "en"), (5, "mail a@b.cc " * 20_000, "en")]
    docs, bench = documents(spark, rows), spark.createDataFrame([(1, "say little")], "item_id long, text string")
    assert sorted(r["doc_id"] or 0 for r in stages.known_language(docs).collect()) == [0, 4, 4, 5]
    assert sorted(r["doc_id"] or 0 for r in stages.one_of_each_group(docs).collect()) == [0, 1, 2, 3, 4, 5]
    assert sorted(r["doc_id"] or 0 for r in stages.not_in_benchmark(docs, bench).collect()) == [0, 1, 2, 3, 5]
    masked = {r["doc_id"]: r["text"] for r in stages.without_personal_data(docs).collect()}
    assert masked[5] == "mail <EMAIL> " * 20_000 and masked[1] is None
    assert stages.packed(docs, tokenizer_file()).filter("piece = 0").count() == len(rows)
    for stage in (stages.known_language, stages.one_of_each_group, stages.without_personal_data, lambda d: stages.not_in_benchmark(d, bench), lambda d: stages.packed(d, tokenizer_file())):
        assert stage(docs.limit(0)).count() == 0
