"""The pipeline stage by stage, each on its own input, against brute force."""

import random
import re
from collections import Counter

import corpus_pipeline as pipeline
from sieveline.llm import bpe_automaton
from tokenizers import Tokenizer

from . import helpers
from .test_documents import brute_groups, brute_targets


def corpus(spark):
    r = random.Random(3)
    words = {"en": "the of and that which with house under water people run far away home".split(), "de": "der und nicht auf haus unter wasser leute schön über laufen weit weg heim".split()}
    rows = []
    for k in range(120):
        lang = ("en", "de")[k % 2]
        rows.append((k, " ".join(r.choice(words[lang]) + str(r.randrange(40)) for _ in range(r.randrange(30, 120))), lang, f"s{k % 4}", 1))
    rows += [(200, rows[0][1].upper(), "en", "s0", 1), (201, rows[5][1] + " one more", "de", "s1", 1), (202, None, None, None, None), (203, "это другой язык совсем", None, "s2", 1), (204, "", "en", "s2", 0)]
    return rows, spark.createDataFrame([(*x, "c") for x in rows], "doc_id long, text string, lang string, source string, n_chars long, kept string")


def test_stages(spark):
    rows, docs = corpus(spark)
    text = {r[0]: r[1] for r in rows}
    steps = dict(pipeline.STAGES)
    assert [n for n, _ in pipeline.STAGES] == ["language_id", "exact_dedup", "near_dedup", "mix_sources", "bpe_encode"]
    out = steps["language_id"](spark, docs, "")
    assert out.columns == docs.columns
    kept = {r.doc_id for r in out.collect()}
    assert kept == set(text) - {202, 203, 204}
    out = steps["exact_dedup"](spark, docs, "")
    low = lambda t: "".join(c.lower() if "A" <= c <= "Z" else c for c in t or "")
    last = {}
    for k, t in text.items():
        last[low(t)] = max(last.get(low(t), k), k)
    assert out.columns == docs.columns and {r.doc_id for r in out.collect()} == set(last.values())
    out = steps["near_dedup"](spark, docs, "")
    groups = brute_groups([(k, t) for k, t in text.items()])
    assert {r.doc_id for r in out.collect()} == {k for k, g in groups.items() if g == k}
    out = steps["mix_sources"](spark, docs, "")
    assert out.columns == docs.columns
    size, taken = Counter(), Counter()
    for _, t, _, s, _ in rows:
        size[s] += len(re.findall(r"[^\x20\x09-\x0D]+", t or ""))
    for r in out.collect():
        taken[r.source] += len(r.text.split())
        assert r.n_chars == len(r.text) and set(r.text.split()) <= set(text[r.doc_id].split())
    assert all(abs(taken[s] - t) <= 130 for s, t in brute_targets(size).items())
    library = Tokenizer.from_file(bpe_automaton.default_tokenizer())
    for r in steps["bpe_encode"](spark, docs, "").collect():
        assert r.ids == library.encode(text[r.doc_id] or "", add_special_tokens=False).ids and r.n_tokens == len(r.ids)


CLASHES = ("row", "parts", "whole", "rejected", "lang_pred", "score", "kept", "times", "copy", "at", "size", "id", "group_id", "c0", "key", "block")


def test_columns_with_clashing_names_stay_as_they_are(spark):
    from pyspark.sql import functions as F

    rows, docs = corpus(spark)
    docs = docs.drop("kept")
    plain = docs.select("*", *[F.concat(F.lit(f"{c} "), F.col("doc_id").cast("string")).alias(c) for c in CLASHES])
    for name, step in pipeline.STAGES[:-1]:
        out = step(spark, plain, "")
        assert out.columns == plain.columns
        got = out.collect()
        assert got and all(r[c] == (None if r.doc_id is None else f"{c} {r.doc_id}") for r in got for c in CLASHES), name
        assert Counter((r.doc_id, r.text) for r in got) == Counter((r.doc_id, r.text) for r in step(spark, docs, "").collect()), name
    assert pipeline.STAGES[-1][1](spark, plain, "").count() == len(rows)


def test_run_and_edge_cases(spark, tmp_path):
    rows, docs = corpus(spark)
    docs.write.parquet(f"{tmp_path}/documents.parquet")
    got = pipeline.run(spark, str(tmp_path))
    again = pipeline.run(spark, str(tmp_path))
    assert Counter((r.doc_id, tuple(r.ids)) for r in got.collect()) == Counter((r.doc_id, tuple(r.ids)) for r in again.collect())
    assert {0, 201, 202, 203, 204}.isdisjoint({r.doc_id for r in got.select("doc_id").collect()})
    odd = str(tmp_path / "odd")
    helpers.documents(spark, odd)
    pipeline.run(spark, odd).collect()
    none = str(tmp_path / "none")
    helpers.empty_documents(spark, none)
    assert pipeline.run(spark, none).collect() == []
