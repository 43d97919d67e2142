"""Wrapper induction: tree matching against brute force, and what wrappers decide."""

import random
from functools import lru_cache

from pyspark.sql import functions as F

from lexiforge.llm import html_extract as H
from lexiforge.llm import warc
from lexiforge.llm.dom import read

from .helpers import text_maker


def random_tree(rnd, depth, path=""):
    t = H.Tree(rnd.choice("abc") if not path else path[-1], path, [0])
    if depth:
        names = [n for n in "abcde" if rnd.random() < 0.6]
        rnd.shuffle(names)
        t.children = [random_tree(rnd, depth - 1, f"{path}/{n}") for n in names]
    return t


def best_matching(a, b):
    """The largest simple tree matching by trying every choice of the last children."""

    @lru_cache(None)
    def roots(x, y):
        return 0 if x.name != y.name else 1 + rows(x, y, len(x.children), len(y.children))

    @lru_cache(None)
    def rows(x, y, i, j):
        if not i or not j:
            return 0
        return max(rows(x, y, i - 1, j), rows(x, y, i, j - 1), rows(x, y, i - 1, j - 1) + roots(x.children[i - 1], y.children[j - 1]))

    return roots(a, b)


def test_tree_matching_equals_brute_force():
    rnd = random.Random(12)
    for _ in range(150):
        a, b = random_tree(rnd, 3, "/r"), random_tree(rnd, 3, "/r")
        size, pairs = H.match(a, b)
        assert size == len(pairs) == best_matching(a, b)
        assert all(x.name == y.name for x, y in pairs)
        for x, y in pairs:  # parents and the order of siblings are kept
            at = [(x.children.index(c), y.children.index(d)) for c, d in pairs if c in x.children and d in y.children]
            assert all(i < j for (_, i), (_, j) in zip(sorted(at), sorted(at)[1:], strict=False))
    assert H.match(random_tree(rnd, 0, "/a"), random_tree(rnd, 0, "/b")) == (0, [])


def test_deep_pages_are_read_whole():
    page = "<div>" * 3000 + "<p>deep text</p>" + "</div>" * 3000
    assert H.extract(page, []) == "deep text"
    assert H.induce([page, page.replace("deep", "other")])["root"].count("/") > 2000


def pages_of(make, k, body):
    return f"<html><body><div class='top'>The Daily Host</div>{body}<div class='end'>All rights of the Daily Host</div></body></html>"


def test_wrapper_finds_content_without_an_article():
    """A page of several sibling sections and a heading, between unmarked template text."""
    _, make = text_maker(3)
    bodies = [[make(5), *(make(30) for _ in range(3))] for _ in range(8)]
    page = lambda b, k: pages_of(make, k, f"<div class='w'><h1>{b[0]}</h1><div class='c'>" + "".join(f"<section class='s'><p>{t}</p></section>" for t in b[1:]) + "</div></div>")
    pages = [page(b, k) for k, b in enumerate(bodies)]
    w = H.induce(pages)
    for p, b in zip(pages, bodies, strict=True):
        assert H.extract(p, [w]) == " ".join(b)
        assert H.extract(p, []) != " ".join(b)


def test_template_inside_an_article_goes_and_shared_passages_stay():
    _, make = text_maker(7)
    furniture, passage = "Read our daily letter with a cup of tea", make(40)
    page = lambda *t: f"<html><body><article><h1>{t[0]}</h1><p>{furniture}</p>" + "".join(f"<p>{x}</p>" for x in t[1:]) + "</article></body></html>"
    texts = [[make(4), make(60), *([passage] if k % 2 else []), make(50)] for k in range(8)]
    pages = [page(*t) for t in texts]
    w = H.induce(pages)
    for p, t in zip(pages, texts, strict=True):
        assert H.extract(p, [w]) == " ".join(t)
        assert furniture in H.extract(p, [])
    # Copies of one article agree on nearly all, which is no template.
    base = [make(40) for _ in range(6)]
    copies = [page(make(3), *base) for _ in range(8)]
    w = H.induce(copies)
    assert all(" ".join(base) in H.extract(p, [w]) for p in copies)


def test_formulas_stay_and_scripts_go():
    page = "<article><p>Let <math><mi>x</mi><mo>=</mo><mn>2</mn><annotation>x=2</annotation></math> be.</p><svg><text>label</text><desc>no</desc></svg><script>no()</script><noscript>turn on</noscript><p>A&nbsp;&lt;b&gt;\n c</p></article>"
    assert H.extract(page, []) == "Let x=2 be. label A <b> c"
    several = "<main><article><p>one</p></article></main><main><article><p>two</p></article></main>"
    assert H.extract(several, []) == "one two"


def test_pages_of_many_hosts_in_spark(spark):
    _, make = text_maker(9)
    rows, want = [], {}
    for k in range(120):
        body = [make(40), make(25)]
        rows.append((k, f"https://Host{k % 3}.example/{k}", pages_of(make, k, "<div class='c'>" + "".join(f"<p>{t}</p>" for t in body) + "</div>")))
        want[k] = " ".join(body)
    rows += [(500, None, None), (501, "bad", ""), (502, None, "<p>lone page</p>"), (0, rows[0][1], rows[0][2]), (None, "https://host1.example/x", rows[1][2])]
    pages = spark.createDataFrame(rows, "page_id long, url string, html string").withColumns({c: F.lit("clash") for c in ("host", "h", "text", "wrapper", "n_chars")})
    got = H.extract_pages(pages).collect()
    assert len(got) == len(rows)
    for r in got:
        expected = want.get(r["page_id"], {500: "", 501: "", 502: "lone page", None: want[1]}.get(r["page_id"]))
        assert r["text"] == expected and r["n_chars"] == len(expected)
    assert H.extract_pages(pages.where("false")).count() == 0


def test_very_long_page():
    body = " ".join(f"<p>paragraph {k} of a long page</p>" for k in range(20_000))
    text = H.extract(f"<body><nav>menu</nav><article>{body}</article></body>", [])
    assert text.count("paragraph") == 20_000 and "menu" not in text and len(read(body)[1]) == 20_000


def test_fixity_equals_comparing_all_records(spark, tmp_path):
    """Changed, lost and added records of replicas of several files, against a comparison of all."""
    rnd = random.Random(2)
    body = F.concat(F.repeat(F.md5(F.col("id").cast("string")), F.lit(30)), F.when(F.col("id").isin(*rnd.sample(range(2000), 9)), "!").otherwise("?"))
    pages = spark.range(2000).select(F.col("id").alias("page_id"), F.lit("u").alias("url"), F.repeat(F.md5(F.col("id").cast("string")), F.lit(30)).alias("html"), body.alias("other")).repartitionByRange(4, "page_id").sortWithinPartitions("page_id")
    write = lambda df, c, to: warc.write(df.select(warc.record(F.col("page_id"), F.col("url"), F.col(c))), f"{tmp_path}/{to}", 300)
    write(pages, "html", "a")
    write(pages.where("page_id <> 1999").withColumn("other", F.when(F.col("other").endswith("!"), F.concat(F.left("html", F.length("html") - 1), F.lit("!"))).otherwise(F.col("html"))), "other", "b")
    a, b = warc.fixity(spark, f"{tmp_path}/a").cache(), warc.fixity(spark, f"{tmp_path}/b").cache()
    key = lambda r: (r["file"], r["at"])
    x, y = ({key(r): (r["page_id"], bytes(r["hash"]), r["length"]) for r in df.where("level = -1").collect()} for df in (a, b))
    want = {(*k, "missing" if k not in y else "extra" if k not in x else "changed") for k in x | y if x.get(k) != y.get(k)}
    got = {(r["file"], r["offset"], r["status"]) for r in warc.audit(a, b).collect()}
    assert got == want and len(want) >= 9
