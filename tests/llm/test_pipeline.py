"""Each stage of the pipeline is held against a plain re-computation on its own input."""

import zlib

import corpus_pipeline
import numpy as np
from evidentia.llm import quality
from evidentia.llm.common import documents
from evidentia.llm.wordpiece import public_path
from tokenizers import Tokenizer

from tests.llm.test_decontaminate import brute as brute_contamination
from tests.llm.test_simhash import brute_print
from tests.llm.test_substrings import brute as brute_repeats

SF = "/root/testdata/sf0.001"


def test_stages(spark, tmp_path):
    docs = documents(spark, SF)
    seen = {"input": sorted(docs.collect(), key=lambda r: r.doc_id)}
    for name, stage in corpus_pipeline.STAGES:
        out = stage(spark, docs, SF)
        out.write.parquet(f"{tmp_path}/{name}")
        columns, docs = docs.columns, spark.read.parquet(f"{tmp_path}/{name}")
        if name != "packing":
            assert docs.columns == columns
        seen[name] = sorted(docs.collect(), key=lambda r: r.doc_id)
    ids = {k: [r.doc_id for r in v] for k, v in seen.items()}

    machine = quality.train(documents(spark, SF), documents(spark, SF, "labels"))
    assert ids["quality"] == [r.doc_id for r in seen["input"] if machine.score(r.text) >= 0.3]

    prints = {r.doc_id: brute_print(r.text) for r in seen["quality"]}
    root = {d: d for d in prints}
    for _ in prints:
        new = {a: min(root[b] for b in prints if (prints[a] ^ prints[b]).bit_count() <= 3) for a in prints}
        if new == root:
            break
        root = new
    assert ids["near_duplicates"] == sorted({*root.values()})

    cut = {int(d): (n, gone) for d, n, gone, _ in brute_repeats([(r.doc_id, r.text) for r in seen["near_duplicates"]], 50)}
    assert ids["substrings"] == [r.doc_id for r in seen["near_duplicates"] if not cut[r.doc_id][1] or cut[r.doc_id][1] < cut[r.doc_id][0]]
    before = {r.doc_id: r for r in seen["near_duplicates"]}
    for r in seen["substrings"]:
        if cut[r.doc_id][1]:
            assert len(r.text.split()) == cut[r.doc_id][0] - cut[r.doc_id][1] and r.n_chars == len(r.text)
        else:
            assert r == before[r.doc_id]

    items = [(r.item_id, r.text) for r in documents(spark, SF, "benchmark").collect()]
    assert ids["decontamination"] == [r.doc_id for r in seen["substrings"] if not brute_contamination(r.text, items)[3]]

    t, want = Tokenizer.from_file(public_path()), []
    for r in seen["decontamination"]:
        x = t.encode(r.text, add_special_tokens=False).ids + [0]
        want += [(r.doc_id, i, zlib.crc32(np.array(x[s : s + 2048], "<u4").tobytes())) for i, s in enumerate(range(0, len(x), 2048))]
    assert sorted((r.doc_id, r.piece, r.ids_crc32) for r in seen["packing"]) == sorted(want)


def test_run(spark):
    assert corpus_pipeline.run(spark, SF).count() > 0
    assert 4 <= len(corpus_pipeline.STAGES) <= 5


def test_stages_on_untidy_rows(spark, tmp_path):
    """Null and repeated ids, null, blank and very long texts, and names that the operators use themselves."""
    names = ["_score", "_found", "_row", "_id", "_fp", "doc", "row", "found", "kept", "packed"]
    say = lambda a, b, w="w": " ".join(f"{w}{i}" for i in range(a, b))
    texts = [
        (1, say(0, 300)), (2, say(0, 300)), (2, say(500, 700) + " " + say(100, 200)), (2, say(900, 999)), (None, say(2000, 2100)), (None, say(2000, 2100)),
        (None, None), (3, ""), (4, " \n"), (5, "one"), (6, "long " * 60_000), (7, say(0, 300).upper()), (7, say(900, 999)),
    ]
    docs = spark.createDataFrame([(d, t, "en", "s", len(t or ""), *names) for d, t in texts], "doc_id long, text string, lang string, source string, n_chars long, " + ", ".join(f"{n} string" for n in names))
    empty = {name: stage(spark, docs.limit(0), SF) for name, stage in corpus_pipeline.STAGES}
    assert all(df.collect() == [] for df in empty.values())
    kept = {}
    for name, stage in corpus_pipeline.STAGES[:-1]:
        out = stage(spark, docs, SF)
        assert out.columns == docs.columns and out.dtypes == docs.dtypes
        kept[name] = out.collect()
        assert all([r[n] for n in names] == names for r in kept[name])
    rows = lambda name: sorted(str((r.doc_id, r.text)) for r in kept[name])
    machine = quality.train(docs, documents(spark, SF, "labels"))
    assert rows("quality") == sorted(str((d, t)) for d, t in texts if machine.score(t) >= 0.3)
    groups = {}
    for i, (d, t) in enumerate(texts):
        groups.setdefault(brute_print(t), []).append((d is None, d or 0, i))
    near = lambda p, q: (p ^ q).bit_count() <= 3
    assert not any(near(p, q) for p in groups for q in groups if p < q)  # no chains here: a fingerprint is a group
    assert len(kept["near_duplicates"]) == len(groups)
    assert sorted(str(r.doc_id) for r in kept["near_duplicates"]) == sorted(str(texts[min(g)[2]][0]) for g in groups.values())
    assert rows("decontamination") == sorted(map(str, texts))
    cut = sorted(str(x) for x in kept["substrings"])
    left = {(str(r.doc_id), r.text) for r in kept["substrings"]}
    assert len(cut) == len(texts) - 2  # the copies of document 1 and of the first text of 900 to 999 are gone
    assert ("2", say(500, 700)) in left and ("2", say(900, 999)) in left and ("None", None) in left and ("6", "long " * 60_000) in left
    packed = corpus_pipeline.STAGES[-1][1](spark, docs, SF).collect()
    assert {str(r.doc_id) for r in packed} == {str(d) for d, _ in texts} and sum(r.piece == 0 for r in packed) == len(texts)
