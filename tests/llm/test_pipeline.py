"""The pipeline's stages against brute force, each on its own input."""

from collections import Counter

from test_operators import SCHEMA, brute_components, corpus, frame, measured, words8

import corpus_pipeline as P
from spatlas.llm import mixing, quality_rules
from spatlas.llm.line_templates import line_dedup
from spatlas.storage import stored


def test_stages(spark, tmp_path):
    rows = corpus(n=120)
    bench = [(1, " ".join(rows[5][1].split()[10:30])), (2, "no such words anywhere in here at all my friend ok")]
    spark.createDataFrame(bench, "item_id long, text string").write.parquet(str(tmp_path / "benchmark.parquet"))
    frame(spark, rows).write.parquet(str(tmp_path / "documents.parquet"))
    docs, sizes = frame(spark, rows).select(P.COLUMNS), {}
    for name, stage in P.STAGES:
        before = [(r.doc_id, r.text) for r in docs.collect()]
        docs = stored(stage(spark, docs, str(tmp_path)), name)
        after = [(r.doc_id, r.text) for r in docs.collect()]
        sizes[name] = len(after)
        if name != "mixed":
            assert docs.columns == P.COLUMNS
        if name == "quality":
            good = []
            for i, t in before:
                m = dict(zip(quality_rules.MEASURES, measured(t), strict=True))
                bits = sum(1 << k for k, (_, rule) in enumerate(quality_rules.RULES) if eval(rule.replace(" OR ", " or "), {}, m))  # noqa: S307
                good += [(i, t)] if not bits & quality_rules.POLICIES["v2"] else []
            assert sorted(after, key=repr) == sorted(good, key=repr) and (120, "word " * 3000) not in after
        if name == "lines":
            assert sorted(map(str, (i for i, _ in before))) == sorted(map(str, (i for i, _ in after)))
            kept = Counter(line for _, t in after for line in (t or "").split("\n"))
            assert not kept - Counter(line for _, t in before for line in (t or "").split("\n"))  # lines go, none come
            assert sorted(after, key=repr) == sorted(((r.doc_id, r.text) for r in line_dedup(stored(frame(spark, before), "again")).collect()), key=repr)
        if name == "near_duplicates":
            groups = {c for _, _, c in brute_components(before)}
            assert sorted(map(str, groups)) == sorted({str(i) for i, _ in after})
        if name == "decontaminated":
            windows = {tuple(w[k : k + 10]) for _, t in bench for w in [words8(t)] for k in range(len(w) - 9)}
            clean = [(i, t) for i, t in before if not any(tuple(w[k : k + 10]) in windows for w in [words8(t)] for k in range(len(w) - 9))]
            assert sorted(after, key=repr) == sorted(clean, key=repr) and len(after) < len(before)
        if name == "mixed":
            drawn, words = docs.collect(), {i: len(t.split()) for i, t in before if i is not None}
            assert {(r.doc_id, r.text) for r in drawn} <= set(before) and all(r.n_copies >= 1 and abs(r.n_copies - r.weight) < 1 and r.n_tokens == words.get(r.doc_id, r.n_tokens) for r in drawn)
            every = mixing.mix(stored(frame(spark, before), "again"), share=0.5, power=0.5, seed=7).collect()
            assert abs(sum(r.weight * r.n_tokens for r in every) / sum(r.n_tokens for r in every) - 0.5) < 1e-3
    assert 0 < sizes["mixed"] <= sizes["decontaminated"]
    assert P.run(spark, str(tmp_path)).count() == sizes["mixed"]
    spark.createDataFrame([], SCHEMA).write.parquet(str(tmp_path / "none/documents.parquet"))
    spark.createDataFrame(bench, "item_id long, text string").write.parquet(str(tmp_path / "none/benchmark.parquet"))
    assert P.run(spark, str(tmp_path / "none")).count() == 0
