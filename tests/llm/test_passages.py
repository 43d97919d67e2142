"""Passages inside other text, and hot groups of near copies, against brute force."""

import random
import re
from collections import defaultdict

from lexiforge.llm import near_dedup, paragraph_dedup, passages
from pyspark.sql import functions as F

from .helpers import frame, odd_rows, text_maker, words
from .test_operators import near_brute


def inline_corpus():
    """Texts that share passages of 40 to 130 words within longer, wrapped and joined lines."""
    rnd, make = text_maker(21)
    shared = [make(n) for n in (40, 51, 60, 75, 130)]
    rows = [(k, make(rnd.randrange(0, 160)), "a") for k in range(20)]
    for k in range(20, 60):
        parts = [make(rnd.randrange(3, 60))]
        for s in rnd.sample(shared, rnd.randrange(1, 4)):
            w = s.split()
            if rnd.random() < 0.3:  # wrapped over short lines, in other case
                s = "\n".join(" ".join(w[j : j + 12]) for j in range(0, len(w), 12)).upper()
            if rnd.random() < 0.3:  # cut on one side
                s = " ".join(s.split()[rnd.randrange(0, 10) :])
            parts += [s, make(rnd.randrange(0, 30))]
        rows.append((k, " ".join(parts), "b"))
    return rows


def late_windows(rows):
    """(doc_id, word) of every window of 50 words that stands in an earlier place too."""
    first, late = {}, set()
    for d, t, _ in sorted(rows, key=lambda r: r[0]):
        w = words(re.sub("[A-Z]", lambda m: m[0].lower(), t or ""))
        for k in range(len(w) - 49):
            e, at = first.setdefault(tuple(w[k : k + 50]), (d, k))
            if (e, at) != (d, k) and not (e == d and k - at < 50):
                late.add((d, k))
    return late


def test_passages_inside_other_text_equal_brute_force(spark):
    rows = inline_corpus()
    got, sources = set(), set()
    text = {d: words(re.sub("[A-Z]", lambda m: m[0].lower(), t or "")) for d, t, _ in rows}
    for r in passages.passages(frame(spark, rows, extra=True)).collect():
        if not r["removed"]:
            sources.add((r["doc_id"], r["word"], r["n_words"]))
            continue
        got |= {(r["doc_id"], k) for k in range(r["word"], r["word"] + r["n_words"] - 49)}
        assert text[r["doc_id"]][r["word"] : r["word"] + r["n_words"]] == text[r["first_doc_id"]][r["first_word"] : r["first_word"] + r["n_words"]]
    want = late_windows(rows)
    assert got == want and len(want) > 200 and sources


def test_passages_of_one_long_text_and_many_copies(spark):
    rnd = random.Random(5)
    long = " ".join(f"w{rnd.randrange(10**6)}" for _ in range(60_000))
    rows = [(1, long, "a"), *((k, f"x{k} " + " ".join(long.split()[500 : 500 + 80]) + f" y{k}", "a") for k in range(2, 300))]
    got = passages.passages(frame(spark, rows)).where("removed").collect()
    assert {(r["doc_id"], r["word"], r["n_words"], r["first_doc_id"], r["first_word"]) for r in got} == {(k, 1, 80, 1, 500) for k in range(2, 300)}


def test_removal_spares_unique_text_of_nameless_and_repeated_ids(spark):
    _, make = text_maker(33)
    passage, a, b, c = make(60), make(60), make(45), make(70)
    rows = [(1, passage, "a"), (2, f"{a}\n{passage}", "a"), (2, f"{b} {passage} {b}", "a"), (None, f"{c}\n{passage}", "a"), (None, a + " zz", "a"), (3, None, "a")]
    docs = frame(spark, rows, extra=True)
    out = paragraph_dedup.without_repeats(docs)
    assert out.columns == docs.columns and out.where("size = 'clash'").count() == len(rows)
    kept = sorted((str(r["doc_id"]), re.sub(" +", " ", r["text"] or "")) for r in out.select("doc_id", "text").collect())
    # "a zz" is a near copy of the line a, which stands in a text with an id and so comes first.
    assert kept == sorted([("1", passage), ("2", a), ("2", f"{b} {b}"), ("None", c), ("None", ""), ("3", "")])
    for rows in ([], odd_rows()):
        assert paragraph_dedup.without_repeats(frame(spark, rows)).count() == len(rows)


def hot_near_copies(copies, seed=4):
    """A large group of edited copies whose links are sparse, and others of the same words."""
    rnd, make = text_maker(seed)
    base = make(120).split()
    rows = []
    for k in range(copies):
        w = list(base)
        for _ in range(rnd.randrange(0, 9)):
            w[rnd.randrange(len(w))] = make(1)
        rows.append((k, " ".join(w), "hot"))
    return rows + [(10**6 + k, make(80), "cold") for k in range(40)]


def test_hot_bucket_equals_brute_force(spark):
    rows = hot_near_copies(260)
    for num, width in ((85, 3), (80, 5)):
        got = near_dedup.near_duplicates(frame(spark, rows), num=num, width=width).collect()
        assert {r["doc_id"]: (r["n_shingles"], r["component_id"]) for r in got} == near_brute(rows, width, num, 100)


def test_rest_is_found_by_rare_shingles_alone(spark, monkeypatch):
    from lexiforge.llm import links

    monkeypatch.setattr(links, "ROUNDS", 0)
    rows = hot_near_copies(150, seed=9)
    got = near_dedup.near_duplicates(frame(spark, rows)).collect()
    assert {r["doc_id"]: (r["n_shingles"], r["component_id"]) for r in got} == near_brute(rows, 3, 85, 100)


def test_one_of_each_group_stays(spark):
    rnd, make = text_maker(6)
    base = make(100)
    near = lambda: " ".join([make(1), *base.split()[1:]])
    unique = [make(60) for _ in range(4)]
    rows = [(5, base, "a"), (5, near(), "a"), (5, unique[0], "a"), (6, near(), "a"), (6, unique[1], "a"), (7, unique[2], "a"), (None, unique[3], "a"), (None, near(), "a"), (8, None, "a"), (9, "", "a")]
    docs = frame(spark, rows, extra=True).withColumns({c: F.lit("mine") for c in ("lost_doc", "lost_body", "key", "body", "__lost", "__sha", "m_size")})
    out = near_dedup.keep_one_each(docs)
    assert out.columns == docs.columns
    kept = [(r["doc_id"], r["text"]) for r in out.collect()]
    assert (5, unique[0]) in kept and (6, unique[1]) in kept and (7, unique[2]) in kept and (None, unique[3]) in kept
    assert sum(bool(t) and t not in unique for _, t in kept) == 1


def test_signatures_are_fair():
    """Matching places of pairs at a known Jaccard index: mean and spread as of independent draws."""
    import numpy as np

    from lexiforge.llm.minhash import minhash

    rnd = np.random.default_rng(3)
    matched = []
    for _ in range(300):
        common, own = rnd.integers(0, 2**64, 80, dtype=np.uint64), rnd.integers(0, 2**64, 20, dtype=np.uint64)
        a, b = np.sort(np.concatenate([common, own[:10]])), np.sort(np.concatenate([common, own[10:]]))
        sig = minhash(np.concatenate([a, b]), np.array([0, len(a), len(a) + len(b)]), 48)
        matched.append((sig[0] == sig[1]).mean())
    assert abs(np.mean(matched) - 0.8) < 0.012 and abs(np.std(matched) - (0.16 / 48) ** 0.5) < 0.012


def test_clusters_of_lines_and_passages_are_disjoint_kinds(spark):
    rows = inline_corpus()
    by = defaultdict(int)
    for r in paragraph_dedup.all_repeats(frame(spark, rows)).collect():
        by[r["kind"]] += 1
        assert r["n_words"] >= (30 if r["kind"] == "paragraph" else 50)
    assert by["passage"] > 20
