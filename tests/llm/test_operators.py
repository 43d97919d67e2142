import hashlib
import re
from collections import defaultdict
from itertools import combinations

import pytest
from pyspark.sql import functions as F

from lexiforge.llm import exact_dedup, html_extract, line_dedup, mixing, near_dedup, packing, paragraph_dedup, quality, token_files, warc
from lexiforge.llm.components import components

from .helpers import SPACE, Union, frame, odd_rows, text_maker, words


@pytest.fixture(scope="module")
def corpus(spark):
    """Clean texts, exact and near copies in small and large groups, and shared paragraphs."""
    rnd, make = text_maker(11)
    rows = [(k, make(rnd.randrange(0, 120)), f"s{rnd.randrange(4)}") for k in range(60)]
    base, shared = make(90), make(55)
    for k in range(60, 100):
        w = base.split()
        for _ in range(rnd.randrange(0, 4)):
            w[rnd.randrange(len(w))] = make(1)
        rows.append((k, " ".join(w), "hot"))
    rows += [(k, base.replace(" ", "\t"), "hot") for k in range(100, 140)]
    rows += [(k, f"{make(20)}\n{shared}\n{make(40)}", f"s{k % 7}") for k in range(140, 155)]
    return rows


def test_exact_dedup_equals_brute_force(spark, corpus):
    for rows in (corpus, odd_rows()):
        got = exact_dedup.decide(frame(spark, rows, extra=True), counters=8).collect()
        groups = defaultdict(list)
        for d, t, _ in rows:
            groups[hashlib.sha256(re.sub(r"[\x20\x09-\x0D]+", " ", t or "").encode()).hexdigest()].append(d)
        assert len(got) == len(rows)
        for sha, ids in groups.items():
            mine = [r for r in got if r["text_sha256"] == sha]
            best = min((i for i in ids if i is not None), default=None)
            assert sorted(str(r["doc_id"]) for r in mine) == sorted(map(str, ids))
            assert all(r["keep_id"] == best and r["group_size"] == len(ids) for r in mine)
            assert [r["doc_id"] for r in mine if r["kept"]] == [best]


def test_exact_dedup_keeps_columns_and_one_repeat(spark):
    rows = odd_rows()
    out = exact_dedup.drop_copies(frame(spark, rows, extra=True))
    assert "size" in out.columns
    kept = [r["doc_id"] for r in out.collect()]
    assert kept.count(6) == 1 and 7 not in kept and kept.count(None) == 1


def near_brute(rows, width, num, den):
    sets = []
    for d, t, _ in rows:
        w = words(re.sub("[A-Z]", lambda m: m[0].lower(), t or ""))
        sets.append((d, frozenset([tuple(w)] if 0 < len(w) < width else [tuple(w[k : k + width]) for k in range(len(w) - width + 1)])))
    u = Union()
    ids = [(d, s) for d, s in sets if d is not None]
    for (a, x), (b, y) in combinations(ids, 2):
        if x and y and den * len(x & y) >= num * len(x | y):
            u.join(a, b)
    return {d: (len(s), u.find(d)) for d, s in ids}


def test_near_duplicates_equal_brute_force(spark, corpus):
    got = near_dedup.near_duplicates(frame(spark, corpus, extra=True)).collect()
    want = near_brute(corpus, 3, 85, 100)
    assert {r["doc_id"]: (r["n_shingles"], r["component_id"]) for r in got} == want
    assert all(r["kept"] == (r["doc_id"] == r["component_id"]) for r in got)


def test_near_duplicates_of_odd_rows(spark):
    rows = odd_rows()
    got = near_dedup.near_duplicates(frame(spark, rows)).collect()
    want = near_brute(rows, 3, 85, 100)
    assert len(got) == len(rows)
    for r in got:
        if r["doc_id"] is not None:
            assert (r["n_shingles"], r["component_id"]) == want[r["doc_id"]]
    nameless = sorted((r["component_id"] or -1, r["kept"]) for r in got if r["doc_id"] is None)
    assert nameless == [(-1, True), (6, False)]
    assert near_dedup.near_duplicates(frame(spark, [])).count() == 0


def test_components_both_ways(spark):
    edges = [(k, k + 1) for k in range(40)] + [(100, k) for k in range(101, 160)] + [(200, 200), (300, 301)]
    u = Union()
    for a, b in edges:
        if a != b:
            u.join(a, b)
    want = {x: u.find(x) for e in edges if e[0] != e[1] for x in e}
    df = spark.createDataFrame(edges, "a long, b long")
    for small in (10**6, 0):
        assert {r["node"]: r["label"] for r in components(df, small=small).collect()} == want


def test_paragraphs_equal_brute_force(spark, corpus):
    occurrences = defaultdict(list)
    for d, t, _ in corpus:
        for k, line in enumerate((t or "").split("\n")):
            w = words(line.lower())
            if len(w) >= paragraph_dedup.MIN_WORDS:
                occurrences[frozenset(tuple(w[j : j + 5]) for j in range(len(w) - 4))].append((d, k))
    u, sets = Union(), list(occurrences)
    for i, j in combinations(range(len(sets)), 2):
        if 100 * len(sets[i] & sets[j]) >= 80 * len(sets[i] | sets[j]):
            u.join(i, j)
    clusters = defaultdict(list)
    for i, s in enumerate(sets):
        clusters[u.find(i)] += occurrences[s]
    want = {(*o, *min(v), len(v), o != min(v)) for v in clusters.values() if len(v) > 1 for o in v}
    docs = frame(spark, corpus, extra=True)
    got = {tuple(r) for r in paragraph_dedup.repeated(docs).select("doc_id", "paragraph", "first_doc_id", "first_paragraph", "cluster_size", "removed").collect()}
    assert got == want
    clean = {r["doc_id"]: r["text"] for r in paragraph_dedup.without_repeats(docs).select("doc_id", "text").collect()}
    assert len(clean[141].split("\n")) == 2 and len(clean[140].split("\n")) == 3
    assert paragraph_dedup.repeated(frame(spark, odd_rows())).count() >= 2
    assert paragraph_dedup.repeated(frame(spark, [])).count() == 0


def test_mix_comes_near_its_targets(spark, corpus):
    for rows in (corpus, odd_rows()):
        docs = frame(spark, rows, extra=True)
        got = mixing.mixed(docs).collect()
        assert len(got) == len(rows) and sorted(map(tuple, got), key=repr) == sorted(map(tuple, mixing.mixed(docs).collect()), key=repr)
        size, source = defaultdict(int), {}
        for d, t, s in rows:
            size[s] += len(words(t))
            source.setdefault(d, s)
        total, names = sum(size.values()), sorted(size, key=lambda s: (s is None, s or ""))
        weight = {s: k % 3 + 1 for k, s in enumerate(names)}
        target, free = dict.fromkeys(names, 0.0), set(names)
        while True:
            left = total - sum(target[s] for s in names if s not in free)
            share = sum(weight[s] for s in free)
            over = {s for s in free if left * weight[s] / share > 3 * size[s] + 1e-9}
            if not over:
                target.update({s: left * weight[s] / share for s in free})
                break
            target.update({s: 3.0 * size[s] for s in over})
            free -= over
        taken = defaultdict(int)
        by_size = {}
        for r in got:
            assert r["taken"] <= 3 * r["size"]
            by_size[r["source_size"], round(r["target"], 6)] = True
        joined = docs.select("doc_id", "source").distinct().join(mixing.mixed(docs), "doc_id").collect() if None not in source else []
        for r in joined:
            taken[r["source"]] += r["taken"]
        for s in joined and names:
            largest = max(len(words(t)) for _, t, q in rows if q == s)
            assert abs(taken[s] - target[s]) <= largest
        for s in names:
            assert any(a == size[s] and abs(b - target[s]) < 1e-3 for a, b in by_size)
    repeated = mixing.repeat_documents(docs)
    assert repeated.columns == docs.columns
    assert mixing.mixed(frame(spark, [])).count() == 0


def test_packing_of_documents(spark, corpus):
    import zlib

    import numpy as np

    from lexiforge.llm.tokens import default_path, encoder

    e = encoder(default_path()).tokenizer
    for rows in (corpus, odd_rows()):
        got = packing.packed(frame(spark, rows, extra=True)).collect()
        pieces = defaultdict(list)
        for r in got:
            pieces[r["doc_id"]].append(r)
        want = []
        for d, t, _ in rows:
            ids = np.array([*e.encode(t or "", add_special_tokens=False).ids, 0], "<u4")
            want += [(d, k // 2048, k, len(ids[k : k + 2048]), zlib.crc32(ids[k : k + 2048].tobytes())) for k in range(0, len(ids), 2048)]
        key = lambda x: tuple(-1 if v is None else v for v in x)
        assert sorted(((r["doc_id"], r["piece"], r["start"], r["length"], r["ids_crc32"]) for r in got), key=key) == sorted(want, key=key)
        sequences = defaultdict(list)
        for r in got:
            sequences[r["sequence_id"]].append((r["offset"], r["length"]))
        for parts in sequences.values():
            at = 0
            for o, n in sorted(parts):
                assert o == at
                at += n
            assert at <= 2048
        assert len(sequences) <= -(-sum(r["length"] for r in got) // 2048) + 1
    assert packing.packed(frame(spark, [])).count() == 0


def test_token_files_round_trip(spark, corpus):
    import zlib

    import numpy as np

    from lexiforge.llm.tokens import default_path, encoder

    e = encoder(default_path()).tokenizer
    for rows in (corpus, odd_rows()):
        got = token_files.round_trip(frame(spark, rows, extra=True)).orderBy("start").collect()
        want = sorted(((-1 if d is None else d, e.encode(t or "", add_special_tokens=False).ids + [2]) for d, t, _ in rows), key=lambda x: x[0])
        assert [-1 if r["doc_id"] is None else r["doc_id"] for r in got] == [d for d, _ in want]
        at, crcs = 0, defaultdict(list)
        for r in got:
            assert r["start"] == at
            at += r["n_tokens"]
            crcs[r["doc_id"] if r["doc_id"] is not None else -1].append((r["n_tokens"], r["ids_crc32"]))
        expected = defaultdict(list)
        for d, ids in want:
            expected[d].append((len(ids), zlib.crc32(np.array(ids, "<u4").tobytes())))
        assert {k: sorted(v) for k, v in crcs.items()} == {k: sorted(v) for k, v in expected.items()}
    assert token_files.round_trip(frame(spark, [])).count() == 0


def test_lines_of_many_sites_go(spark):
    common, near, rare = "a line of all sites", "a line of four sites", "of one"
    rows = [(k, f"{rare} {k}\n {common}\t\n{near if k < 4 else ''}\n\n{rare} {k}", f"s{k}") for k in range(9)] + [(20, None, None), (21, "", "x"), (None, common, "s0")]
    got = {r["doc_id"]: r for r in line_dedup.cleaned(frame(spark, rows, extra=True)).collect()}
    assert got[1]["n_removed"] == 1 and got[1]["clean"] == f"{rare} 1\n{near}\n\n{rare} 1"
    assert got[None]["clean"] == "" and got[20]["n_lines"] == 0 and got[21]["n_lines"] == 1
    assert len(got) == 12 and line_dedup.cleaned(frame(spark, [])).count() == 0
    assert SPACE.strip(" ") != SPACE


def test_quality_keeps_clean_and_drops_junk(spark):
    rnd, make = text_maker(4)
    clean = [(k, ". ".join(make(9).capitalize() for _ in range(12)), "a") for k in range(300)]
    junk = [(k, " ".join(w + "***" for w in make(100).split()), "a") for k in range(300, 400)]
    docs = frame(spark, clean + junk + [(None, None, None)], extra=True)
    labels = spark.createDataFrame([(d, int(d < 300)) for d, *_ in clean[::2] + junk[::2]] + [(5, None), (None, 1)], "doc_id long, quality int")
    model = quality.fit_model(docs, labels)
    got = {r["doc_id"]: r for r in quality.judged(docs, model).collect()}
    assert all(got[d]["kept"] for d, *_ in clean) and not any(got[d]["kept"] for d, *_ in junk) and got[None]["base_failed"]
    assert quality.keep_good(docs, model).count() == 300
    alone = quality.fit_model(docs, labels.where("false"))
    assert alone.forest is None and quality.judged(frame(spark, []), alone).count() == 0


def test_pages_and_fixity(spark):
    html = "<html><body><nav><a>m{0}</a></nav><article><h1>T {0}</h1><p>body   {0}</p></article><footer>f{0}</footer></body></html>"
    rows = [(k, f"http://h{k % 3}.example/{k}", html.format(k * 31)) for k in range(200)] + [(900, None, None), (901, "x", ""), (3, "http://h0.example/3", html.format(93))]
    pages = spark.createDataFrame(rows, "page_id long, url string, html string").withColumn("host", F.lit("clash"))
    got = {r["page_id"]: r for r in html_extract.extract_pages(pages).collect()}
    assert all(got[k]["text"] == f"T {k * 31} body {k * 31}" for k in range(200)) and got[900]["text"] == "" and got[900]["n_chars"] == 0
    assert html_extract.extract_pages(pages.where("false")).count() == 0
    audited = warc.audited_pages(pages).collect()
    damaged = {r["page_id"] for r in pages.where(warc.damaged(F.col("html"), F.col("page_id")) != F.col("html")).collect()}
    assert len(audited) == len(rows) and {r["page_id"] for r in audited if r["status"] == "changed"} == damaged and damaged
    assert all(r["status"] in ("intact", "changed") for r in audited)


def test_fixity_of_lost_and_extra_records(spark, tmp_path):
    pages = spark.range(300).select(F.col("id").alias("page_id"), F.lit("u").alias("url"), F.repeat(F.lit("x"), F.lit(700)).alias("html")).coalesce(1)
    one = lambda df: df.select(warc.record(F.col("page_id"), F.col("url"), F.col("html")))
    warc.write(one(pages), f"{tmp_path}/a")
    warc.write(one(pages.where("page_id < 290")), f"{tmp_path}/b")
    a, b = warc.fixity(spark, f"{tmp_path}/a"), warc.fixity(spark, f"{tmp_path}/b")
    assert warc.audit(a, a).count() == 0
    assert {(r["page_id"], r["status"]) for r in warc.audit(a, b).collect()} == {(k, "missing") for k in range(290, 300)}
    assert {(r["page_id"], r["status"]) for r in warc.audit(b, a).collect()} == {(k, "extra") for k in range(290, 300)}
