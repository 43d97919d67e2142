"""The corpus pipeline against a plain version of every stage, and its stages on odd rows."""

import hashlib
import math
import re
from collections import Counter, defaultdict

import pytest
from pyspark.sql import functions as F

from lexiforge.llm import quality
from lexiforge.llm.mixing import SEED

from .helpers import odd_rows, words
from .test_operators import near_brute

SMALL = "/root/testdata/sf0.001"


def plain_counts(text):
    """The counts that the quality rules look at, one text at a time."""
    w = words(text)
    lines = [x.strip("\x20\t\n\x0b\x0c\r") for x in text.split("\n")]
    lines = [x for x in lines if x]
    windows = Counter(tuple(w[k : k + 3]) for k in range(len(w) - 2))
    covered = {k + j for k in range(len(w) - 2) if windows[tuple(w[k : k + 3])] > 1 for j in range(3)}
    count = lambda chars: sum(c in chars for c in text)
    return {
        "n_words": len(w), "word_chars": sum(map(len, w)), "n_symbols": count("#*$%&|<>"), "n_dup_lines": len(lines) - len(set(lines)), "n_repeat_words": len(covered), "n_chars": len(text),
        "n_lines": len(lines), "n_upper": sum("A" <= c <= "Z" for c in text), "n_digits": sum("0" <= c <= "9" for c in text), "n_marks": count(".,;:!?"), "n_distinct_words": len(set(w)),
    }


def plain_verdict(model, text):
    """(base_failed, kept) by walking the trees node by node."""
    s = plain_counts(text)
    if s["n_words"] < 50 or 100 * s["n_repeat_words"] > 50 * s["n_words"]:
        return True, False
    n, lines = s["n_words"], max(1, s["n_lines"])
    x = [math.log1p(n), s["word_chars"] / n, s["n_symbols"] / n, s["n_dup_lines"] / lines, s["n_repeat_words"] / n, s["n_upper"] / max(1, s["n_chars"]), s["n_digits"] / max(1, s["n_chars"]), s["n_marks"] / n, s["n_distinct_words"] / n, math.log1p(n / lines)]
    f = model.forest
    margin = f.base
    for root in f.roots:
        at = root
        while f.left[at] != at:
            at = f.left[at] if x[f.feature[at]] <= f.threshold[at] else f.right[at]
        margin += f.value[at]
    return False, 1 / (1 + math.exp(-margin)) >= model.cut


def test_quality_verdicts_equal_plain_counts_and_trees(spark):
    docs = spark.read.parquet("/root/testdata/sf0.01/documents.parquet")
    labels = spark.read.parquet("/root/testdata/sf0.01/labels.parquet")
    model = quality.fit_model(docs, labels)
    again = quality.fit_model(docs.repartition(7), labels.repartition(3))
    assert model.forest is not None and model.cut == again.cut and (model.forest.threshold == again.forest.threshold).all() and (model.forest.value == again.forest.value).all()
    texts = {r["doc_id"]: r["text"] or "" for r in docs.select("doc_id", "text").collect()}
    for r in quality.judged(docs, model).collect():
        counts = plain_counts(texts[r["doc_id"]])
        assert all(r[c] == counts[c] for c in quality.COUNTS)
        assert (r["base_failed"], r["kept"]) == plain_verdict(model, texts[r["doc_id"]])


def test_wrong_labels_do_not_open_the_gate(spark):
    docs = spark.read.parquet("/root/testdata/sf0.01/documents.parquet")
    labels = spark.read.parquet("/root/testdata/sf0.01/labels.parquet").orderBy("doc_id")
    right = {r["doc_id"]: r["kept"] for r in quality.judged(docs, quality.fit_model(docs, labels)).where("not base_failed").collect()}
    wrong = labels.withColumn("quality", F.when(F.col("doc_id") % 41 == 0, 1).otherwise(F.col("quality")))
    got = {r["doc_id"]: r["kept"] for r in quality.judged(docs, quality.fit_model(docs, wrong)).where("not base_failed").collect()}
    junk = [d for d, kept in right.items() if not kept]
    assert junk and sum(not got[d] for d in junk) >= len(junk) / 3
    assert sum(got[d] for d, kept in right.items() if kept) >= 0.98 * sum(right.values())


def plain_mix(rows):
    """{doc_id: times} by filling and clamping round by round, and one seeded order per source."""
    size, by = defaultdict(int), defaultdict(list)
    for d, t, s in rows:
        size[s] += len(words(t))
        by[s].append((hashlib.md5(f"{SEED}:{d}".encode()).hexdigest(), d, len(words(t))))
    names = sorted(size)
    weight = {s: k % 3 + 1 for k, s in enumerate(names)}
    target, free = {}, set(names)
    while free:
        left, share = sum(size.values()) - sum(target.values()), sum(weight[s] for s in free)
        over = {s for s in free if left * weight[s] / share > 3 * size[s]}
        target.update({s: 3.0 * size[s] for s in over} if over else {s: left * weight[s] / share for s in free})
        free -= over or free
    times = {}
    for s in names:
        whole = int(target[s] // size[s]) if size[s] else 0
        part, upto = target[s] - whole * size[s], 0
        for _, d, n in sorted(by[s]):
            upto += n
            times[d] = whole + (2 * upto - n <= 2 * part and size[s] > 0)
    return times


def test_run_equals_plain_stages(spark):
    import corpus_pipeline

    docs = spark.read.parquet(f"{SMALL}/documents.parquet")
    model = quality.fit_model(docs, spark.read.parquet(f"{SMALL}/labels.parquet"))
    rows = [(r["doc_id"], r["text"], r["source"]) for r in docs.orderBy("doc_id").collect()]
    good = [r for r in rows if (plain_verdict(model, r[1] or "")[1] if model.forest else not (plain_counts(r[1] or "")["n_words"] < 50 or 2 * plain_counts(r[1] or "")["n_repeat_words"] > plain_counts(r[1] or "")["n_words"]))]
    seen, exact = set(), []
    for r in good:
        key = re.sub(r"[\x20\x09-\x0D]+", " ", r[1] or "")
        if key not in seen:
            seen.add(key)
            exact.append(r)
    groups = near_brute(exact, 5, 80, 100)
    near = [r for r in exact if groups[r[0]][1] == r[0]]
    times = plain_mix(near)
    got = corpus_pipeline.run(spark, SMALL).collect()
    starts = Counter(r["doc_id"] for r in got if r["piece"] == 0)
    assert starts == Counter({d: n for d, n in times.items() if n}) and len(near) < len(exact) <= len(good) < len(rows)
    sequences = defaultdict(list)
    for r in got:
        sequences[r["sequence_id"]].append((r["offset"], r["length"]))
    for parts in sequences.values():
        parts.sort()
        assert parts[0][0] == 0 and all(a + n == b for (a, n), (b, _) in zip(parts, parts[1:], strict=False)) and sum(n for _, n in parts) <= 2048
    assert len(sequences) <= -(-sum(r["length"] for r in got) // 2048) + 1


def test_stages_hand_on_documents(spark):
    import corpus_pipeline

    from lexiforge.llm.common import stage

    docs = spark.read.parquet(f"{SMALL}/documents.parquet")
    columns, counts = docs.columns, [docs.count()]
    for name, step in corpus_pipeline.STAGES:
        docs = stage(step(spark, docs, SMALL), "test")
        counts.append(docs.count())
        if name != "packing":
            assert docs.columns == columns
    assert counts[0] >= counts[1] >= counts[2] >= counts[3] and counts[-1] >= counts[-2] > 0


CLASHES = (
    "m_source", "m_last", "m_whole", "m_size", "m_n", "m_copies", "__id", "__sha", "__sha_", "__n", "__lost", "sha", "k_id", "k_sha", "key", "body", "lost_doc", "lost_body", "row", "row_source", "h", "n",
    "copies", "digest", "node", "quality", "score", "kept", "label", "piece", "KEY", "Sha",
)


@pytest.mark.parametrize("index", range(5))
def test_stages_stand_odd_rows(spark, index):
    """Nulls, empty and long texts, repeats and clashing columns in every stage; an empty table too."""
    import corpus_pipeline

    data = [(d, t, "en", s, 0) for d, t, s in odd_rows()]
    docs = spark.createDataFrame(data, "doc_id long, text string, lang string, source string, n_chars long")
    docs = docs.withColumns({c: F.lit("mine") for c in CLASHES if c.lower() not in {x.lower() for x in CLASHES[: CLASHES.index(c)]}})
    step = corpus_pipeline.STAGES[index][1]
    out = step(spark, docs, SMALL)
    rows = out.collect()
    assert rows
    if index < 4:
        assert out.columns == docs.columns and all(r["key"] == r["h"] == r["node"] == "mine" for r in rows)
    assert step(spark, docs.where("false"), SMALL).count() == 0
