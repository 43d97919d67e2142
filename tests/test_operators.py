import glob
import io
import math
import os
import random
import re
import shutil
import urllib.parse
import zipfile
import zlib

import duckdb
import numpy as np
import pytest
from pyspark.sql import functions as F

from lexiforge.functions import cache, migrations
from lexiforge.operators import alignment, chunks, elements, evaluate, retrieve, route, settings, snapshot, state, vectors
from lexiforge.sources import artifacts, uploads
from lexiforge.streaming import summaries, turns

from .conftest import SMALL


def channels(spark, lists):
    rows = [(1, c, r, i, None) for c, ids in enumerate(lists) for r, i in enumerate(ids, 1)]
    return spark.createDataFrame(rows, "request_id long, channel int, rank int, chunk_id long, score double")


def order(df, by):
    return [r["chunk_id"] for r in df.orderBy(by).collect()]


def test_fusion_breaks_ties_by_first_seen(spark):
    assert order(retrieve.fuse(channels(spark, [[1, 2, 3], [3, 2, 1]])), "fused_rank") == [1, 3, 2]
    assert order(retrieve.fuse(channels(spark, [[7, 8, 9], [8, 9, 7]])), "fused_rank")[0] == 8


@pytest.mark.parametrize("lists,k,want", [([[1, 2, 3], [1, 2, 3], [4]], 4, [1, 2, 4, 3]), ([[1]] * 6, 3, [1]), ([[k] for k in range(6)], 3, [0, 1, 2])])
def test_quota(spark, lists, k, want):
    ch = channels(spark, lists)
    assert order(retrieve.quota_select(retrieve.fuse(ch), ch, k), "position") == want


def test_diversity_replaces_a_summary(spark):
    kinds = [("prose", None), ("prose", None), ("table_summary", "t1"), ("prose", None), ("table_pack", "t1"), ("formula", None)]
    rows = [(1, k, 1.0 - k / 10, k + 1, "d", kind, t, None, 1) for k, (kind, t) in enumerate(kinds)]
    pool = spark.createDataFrame(rows, "request_id long, chunk_id long, score double, pos int, document_id string, chunk_type string, table_id string, figure_id string, page int")
    assert order(retrieve.diversify(pool), "slot_no") == [0, 1, 4, 3, 5]


def test_floor_and_minimum(spark):
    rows = spark.createDataFrame([(1, 1, 0.80), (1, 2, 0.78), (1, 3, 0.40), (2, 4, 0.3), (2, 5, 0.2)], "request_id long, chunk_id long, score double")
    assert {r["chunk_id"] for r in retrieve.score_floor(rows).collect()} == {1, 2, 4}
    got = {r["chunk_id"]: r["low_confidence"] for r in retrieve.min_score(rows).collect()}
    assert got == {1: False, 2: False, 4: True}


def test_presentation_window(spark):
    def shown(primary, before, after, budget):
        row = [primary, *before, *after]
        df = spark.createDataFrame([tuple(row)], ", ".join(f"c{k} string" for k in range(len(row))))
        cols = [F.col(f"c{k}") for k in range(len(row))]
        return df.select(retrieve.present(cols[0], cols[1 : 1 + len(before)], cols[1 + len(before) :], budget)).first()[0]

    text = shown("p" * 2000, [], [], 300)
    assert text.startswith("[primary]\n" + "p" * 290 + "…") and "1710" in text and "p" * 291 not in text
    text = shown("p" * 100, ["b" * 200] * 2, ["a" * 200] * 2, 150)
    assert "[context:" not in text and text.count("200") >= 1 and len(text) <= 150
    assert len(shown("p" * 2500, ["b" * 400], ["a" * 400], 1200)) <= 1200
    text = shown("p" * 100, ["b" * 10], ["a" * 10], 1200)
    assert text.index("[context:prev #1]\n" + "b" * 10) < text.index("[context:next #1]\n" + "a" * 10)


def test_top_k_is_exact(spark):
    rnd = random.Random(1)
    data = [(k, [rnd.gauss(0, 1) for _ in range(8)]) for k in range(150)]
    unit = [(k, [x / math.sqrt(sum(y * y for y in v)) for x in v]) for k, v in data]
    df = spark.createDataFrame(unit, "id long, v array<double>").repartition(3)
    got = vectors.top_k(df, df.where("id % 20 = 0"), 5)
    for q, v in unit:
        if q % 20 == 0:
            best = sorted((-round(sum(a * b for a, b in zip(v, w, strict=True)), 6), k) for k, w in unit)[:5]
            assert [r["id"] for r in got.where(f"query_id = {q}").orderBy("rank").collect()] == [k for _, k in best]


def test_search_keeps_k_of_each_query_and_streams_the_vectors(spark):
    rnd = np.random.default_rng(3)
    x = rnd.integers(-1, 2, (9000, 4)).astype(float)  # many ties
    q = rnd.integers(-1, 2, (600, 4)).astype(float)
    order = rnd.permutation(len(x))
    best = vectors.Best(q, 7, 6)
    for a in range(0, len(x), 5000):
        best.add(order[a : a + 5000], x[order[a : a + 5000]])
    score = q @ x.T
    for i, (ids, scores) in enumerate(zip(best.ids, best.scores, strict=True)):
        want = np.lexsort((np.arange(len(x)), -score[i]))[:7]
        assert ids.tolist() == want.tolist() and scores.tolist() == score[i][want].tolist()
    few = vectors.Best(q, 7, 6)
    few.add(np.arange(3), x[:3])
    assert sum(b.num_rows for b in few.batches(np.arange(600))) == 1800
    # No task gets pairs of blocks, each with both its matrices.
    v = spark.createDataFrame(list(enumerate(x[:50].tolist())), "id long, v array<double>")
    assert "NestedLoop" not in vectors.top_k(v, v, 2)._jdf.queryExecution().executedPlan().toString()
    assert vectors.top_k(v, v.where("id < 0"), 2).count() == 0 and vectors.top_k(v.where("id < 0"), v, 2).count() == 0


def test_embedding_is_a_unit_bag_of_words(spark):
    rnd = random.Random(5)
    texts = [None, "", "A b, b!", *(" ".join(rnd.choice(["a", "Bé", "c-d", "e9", "Éx"]) for _ in range(rnd.randrange(30))) for _ in range(40))]
    got = [r[0] for r in spark.createDataFrame([(t,) for t in texts], "t string").select(vectors.hashed_bow(F.col("t"))).collect()]
    for text, v in zip(texts, got, strict=True):
        counts = [0] * 64
        for w in re.findall(r"[a-z0-9]+", (text or "").lower()):
            counts[zlib.crc32(w.encode()) % 64] += 1
        length = math.sqrt(sum(c * c for c in counts)) or 1
        assert all(abs(a - b / length) < 1e-12 for a, b in zip(v, counts, strict=True))


def lines(spark, rows):
    return spark.createDataFrame([(1, k, *r) for k, r in enumerate(rows)], "document_id long, ordinal long, type string, label string, level int, text string, page int")


def column(df, name):
    return [r[name] for r in df.orderBy("ordinal").collect()]


def test_sections_and_pages(spark):
    t = lambda label, level=None: ("heading" if label else "paragraph", label or "paragraph", level, "x", None)
    assert column(elements.section_numbers(lines(spark, [t("title"), t(None), t("section_header", 1), t(None), t("title"), t(None)])), "section") == [1, 1, 1, 1, 2, 2]
    assert column(elements.section_numbers(lines(spark, [t("h", 2), t(None), t("h", 3), t(None), t("h", 2)])), "section") == [1, 1, 1, 1, 2]
    pages = lines(spark, [("paragraph", "p", None, "x", p) for p in (None, 1, None, 2)])
    assert column(pages.withColumn("page", elements.fill_pages(F.col("page"))), "page") == [1, 1, 2, 2]


def test_heading_paths(spark):
    h = lambda text, level=None: ("heading", "h", level, text, None)
    rows = [h("A", 1), h("B", 2), ("paragraph", "p", None, "x", None), h("C", 1), h("loose"), ("paragraph", "p", None, "y", None)]
    assert column(elements.heading_paths(lines(spark, rows)), "path") == ["", "A", "A > B", "", "C", "C > loose"]


def plain_fragments(rows):
    """Groups of paragraphs in one forward pass: what is not looked past is the place to join to."""
    out, place = [], None
    for kind, _, _, text, page in rows:
        begin = text.lstrip()
        if kind == "paragraph" and begin[:1].islower() and page is not None and place and place[0] == "paragraph" and place[2] is not None and page == place[2] + 1:
            head = place[1].rstrip()
            if head and head[-1] not in ".!?\"”':":
                place[1] = head[:-1] + begin if head[-1] == "-" else head + " " + begin
                place[3] = page
                continue
        row = [kind, text, page, page]
        out.append(row)
        if kind not in ("figure", "caption", "figure_title_candidate", "footnote") and not (kind == "heading" and not re.match(r"\d+(\.\d+)*\b", text)):
            place = row
    return [tuple(r) for r in out]


def test_fragments_merge(spark):
    rows = [("paragraph", "p", None, "It was cut in the mid-", 1), ("figure", "f", None, "", 1), ("paragraph", "p", None, "dle of a word", 2), ("paragraph", "p", None, "Done.", 2), ("paragraph", "p", None, "lower", 3)]
    assert column(elements.merge_fragments(lines(spark, rows)), "text") == ["It was cut in the middle of a word", "", "Done.", "lower"]
    rnd = random.Random(8)
    for _ in range(12):
        page, rows = 1, []
        for _ in range(60):
            page += rnd.choice((0, 0, 1, 1, 2)) if rnd.random() < 0.5 else 0
            kind = rnd.choice(("paragraph",) * 8 + ("figure", "heading", "footnote", "list_item"))
            rows.append((kind, "x", None, rnd.choice(("low ", "Up", "cut-", "1.2 End", " é", "stop.", "")) + rnd.choice(("", " more", "-", ".")), rnd.choice((page, page, page, None))))
        got = elements.merge_fragments(lines(spark, rows)).orderBy("ordinal").select("type", "text", "page", "page_end").collect()
        assert [tuple(r) for r in got] == plain_fragments(rows)


def test_heading_paths_equal_a_plain_stack(spark):
    rnd = random.Random(9)
    rows = [("heading" if rnd.random() < 0.6 else "paragraph", "x", rnd.choice((None, 1, 2, 3, 5)), rnd.choice(("", "1.2 ", "3 ")) + f"t{k}", 1) for k in range(150)]
    for by_level in (False, True):
        stack, want = [], []
        for kind, _, level, text, _ in rows:
            if kind == "heading":
                number = re.match(r"(\d+(?:\.\d+)*)\s", text)
                rank = (level or 1) if by_level else level or (number and number[1].count(".") + 1)
                if by_level:
                    del stack[rank - 1 :]
                else:
                    while rank and stack and stack[-1][0] >= rank:
                        stack.pop()
                stack.append((rank or (stack[-1][0] + 1 if stack else 1), text))
                want.append(" > ".join(t for _, t in stack[:-1]))
            else:
                want.append(" > ".join(t for _, t in stack))
        assert column(elements.heading_paths(lines(spark, rows), by_level=by_level), "path") == want


def test_spaced_letters_and_cells(spark):
    rnd = random.Random(4)
    texts = ["A t t e n tion 3 . 1 a b", *("".join(rnd.choice("ab  é1.-") for _ in range(30)) for _ in range(200))]
    got = [r[0] for r in spark.createDataFrame([(t,) for t in texts], "t string").select(elements.collapse_spaced(F.col("t"))).collect()]
    plain = lambda t: re.sub(r"(\d)\s+\.\s+(\d)", r"\1.\2", re.sub(r"\b(?:[A-Za-z] ){2,}[A-Za-z]\b", lambda m: m[0].replace(" ", ""), t))
    assert got[0] == "Atten tion 3.1 a b" and got == [plain(t) for t in texts]
    cells = spark.createDataFrame([("1 / 2",), ("1.0 2.0",), ("-",), ("a b",)], "c string")
    assert [r[0] for r in cells.select(elements.split_cell(F.col("c"))).collect()] == [["1", "2"], ["1.0", "2.0"], [], ["a b"]]


def plain_pack(parts, joint, limit):
    out = []
    for p in parts:
        if out and len(joint.join([*out[-1], p])) <= limit:
            out[-1].append(p)
        else:
            out.append([p])
    return [joint.join(x) for x in out]


def plain_chunks(rows):
    """Prose chunks by growing texts, of (type, text, path) rows."""
    groups, last = [], None
    for kind, text, path in rows:
        if kind not in ("paragraph", "list_item"):
            last = None if kind in chunks.BREAKS else last
            continue
        if last is None or last != path:
            groups.append((path, []))
        last = path
        if text.strip():
            groups[-1][1].append(text.strip())
    out = []
    for path, texts in groups:
        lead = len(path) + 1 if path else 0
        pieces = []
        for body in plain_pack(texts, "\n", 1283 - lead):
            if len(body) <= 2051 - lead:
                pieces.append(body)
                continue
            *firm, rest = plain_pack(re.split(chunks.SENTENCE, body), " ", 2051 - lead)
            while len(rest) > 2051 - lead:
                firm.append(rest[: 2048 - lead].strip())
                rest = rest[2048 - lead :].strip()
            pieces += [*firm, rest] if rest else firm
        for k, piece in enumerate(pieces):
            tail = pieces[k - 1] if k else ""
            if len(tail) > 256:
                tail = " ".join(tail[-256:].split()[1:]) or tail[-256:]
            longer = f"{tail} {piece}".strip()
            piece = longer if k and len(longer) + lead <= 2051 else piece
            out.append(f"{path}\n{piece}" if path else piece)
    return out


def test_prose_chunks_equal_growing_texts(spark):
    rnd = random.Random(2)
    for path_of in (lambda: "", lambda: rnd.choice(("a", "a", "b > c"))):
        rows = []
        for _ in range(300):
            kind = rnd.choice(("paragraph",) * 9 + ("list_item", "heading", "table", "caption"))
            words = [rnd.choice(("word", "Ende.", "ü!", "x" * 9)) for _ in range(rnd.choice((0, 3, 40, 40, 120, 700)))]
            rows.append((kind, rnd.choice((" ", "")).join([" ".join(words), ""]), path_of()))
        rows.append(("paragraph", "y" * 9000, ""))
        df = spark.createDataFrame([(7, k, *r) for k, r in enumerate(rows)], "document_id long, ordinal long, type string, text string, path string")
        got = [r["text"] for r in chunks.prose_chunks(df).orderBy("run", "piece").collect()]
        assert got == plain_chunks(rows) and len(got) > 50


def test_neighbors_equal_sorting(spark):
    rnd = random.Random(3)
    rows = [(d, k, rnd.randrange(30), rnd.random() < 0.6) for d in range(3) for k in range(40)]
    got = chunks.neighbors(spark.createDataFrame(rows, "document_id long, chunk_id long, anchor long, prose boolean")).collect()
    assert len(got) == sum(not r[3] for r in rows)
    place = {(d, k): a for d, k, a, _ in rows}
    for r in got:
        at = place[r["document_id"], r["chunk_id"]]
        near = sorted((a, k) for d, k, a, p in rows if p and d == r["document_id"])
        assert r["prev"] == [k for a, k in near if a < at][-2:] and r["next"] == [k for a, k in near if a > at][:2]


def test_alignment_is_forward_only():
    assert alignment.carry_pages(["before", "table", " after "], [("before", 1), ("after", 2)]) == ([1, 1, 2], 2, 3)
    assert alignment.carry_pages(["Before"], [("", 9), ("before", 4)]) == ([4], 0, 1)
    rnd = random.Random(6)
    for _ in range(50):
        units = [(rnd.choice("abc  "), k // 3 + 2) for k in range(30)]
        texts = [rnd.choice("abcd ") for _ in range(40)]
        kept = [(t, p) for t, p in units if t.strip()]
        at, page, want = 0, kept[0][1] if kept else 1, []
        for t in texts:
            hit = next((k for k in range(at, len(kept)) if t.strip() and kept[k][0] == t), None)
            if hit is not None:
                at, page = hit + 1, kept[hit][1]
            want.append(page)
        assert alignment.carry_pages(texts, units)[0] == want


def test_uploads_refuse_what_is_ambiguous():
    assert uploads.sniff("你好".encode()) == "utf-8" and uploads.sniff(b"\xff\xfea\x00") == "utf-16-le" and uploads.sniff(b"\xff\xfe\x00\x00a\x00\x00\x00") == "utf-32-le"
    for text, code in (("，这是一个测试文档。", "gb18030"), ("這是一個測試文件，我們的", "big5"), ("안녕하세요 세계입니다. ", "euc_kr"), ("これはテストの文書です。日本語", "shift_jis"), ("これはテストの文書です。日本語", "euc_jp")):
        assert uploads.sniff(text.encode(code) * 20) == code
    assert uploads.sniff("你好世界".encode("gb18030")) is None and uploads.sniff(bytes(range(128, 256))) is None and uploads.sniff("Ärger über Öl".encode("latin-1") * 40) is None
    assert uploads.transcode(b"\xef\xbb\xbfabc") == "abc" and uploads.transcode(None) is None


def test_accented_capitals_are_no_double_byte_code():
    for text in ("CIÓN!! RACIÓNBO!! OSCIÓN!! LA GARÓN ", "MÄDCHEN HÄTTE SÄLE. "):
        assert uploads.sniff((text * 40).encode("latin-1")) is None
    big5 = "今天天氣很好，所以我們一起去公園散步，看到許多花和樹，也遇見了老朋友。"
    assert uploads.sniff((big5 * 2).encode("big5")) == "big5" and uploads.sniff(("今天天气很好，" * 9).encode("gb18030")) == "gb18030"


def test_table_facts_of_odd_rows_without_interpreted_lambdas(spark):
    data = [
        (1, "t", ["", "Model", "qty", ""], [" a ", "b", "1 / - / 2", "x", " 3  4 ", None]),
        (2, None, [None, "Model", None], [None, "b", "5"]),
        (3, "", ["", "kind"], ["-", "b/c"]),
        (4, "t", ["", "model"], ["a", "b"]),
        (5, "t", None, ["", " "]),
        (6, "t", [], None),
    ]
    rows = spark.createDataFrame(data, "k int, cap string, h array<string>, c array<string>")
    facts = elements.table_facts(rows, F.col("cap"), F.col("h"), F.col("c"))
    got = [(r["k"], r["fact"]) for r in facts.orderBy("k", "cell_no", "value_no").collect()]
    t = "[table-fact] t | a | b | "
    assert got == [(1, t + "qty | 1"), (1, t + "qty | 2"), (1, t + "col5 | 3"), (1, t + "col5 | 4"), (2, "[table-fact] | row | Model | b"), (2, "[table-fact] | row | col3 | 5"), (3, "[table-fact] | - | kind | b/c")]
    assert "lambda" not in facts._jdf.queryExecution().executedPlan().toString()


def test_words_end_at_letters_beyond_ascii(spark):
    texts = ["De Erö und", "éAbc Def", "éuniversityé", "éa@b.cdé", "Abcö Def", "xuniversity", "ltd. und"]
    rows = spark.createDataFrame([(t,) for t in texts], "t string")
    assert [r[0] for r in rows.select(chunks.is_byline(F.lit("body"), F.col("t"), F.lit(True))).collect()] == [True, True, True, True, False, False, True]
    assert spark.createDataFrame([("éemé",), ("them",)], "t string").select(retrieve.wants_tables(F.col("t")).alias("w")).collect() == [(True,), (False,)]


def test_items_of_many_files_go_back_in_parts(spark, monkeypatch):
    files = spark.createDataFrame([(k, "md", "\n\n".join(f"line {n}" for n in range(k))) for k in range(12)], "document_id long, kind string, content string").coalesce(1)
    want = sorted(uploads.parsed(files).collect())
    monkeypatch.setattr(uploads, "ITEMS", 5)
    assert sorted(uploads.parsed(files).collect()) == want and len(want) > 12


def zipped(**files):
    raw = io.BytesIO()
    with zipfile.ZipFile(raw, "w") as z:
        for name, text in files.items():
            z.writestr(name.replace("__", "/").replace("_dot_", "."), text)
    return raw.getvalue()


def test_readers_of_every_format(spark):
    w = 'xmlns:w="http://schemas.openxmlformats.org/wordprocessingml/2006/main"'
    docx = zipped(word__document_dot_xml=f'<w:document {w}><w:body><w:p><w:r><w:t> one </w:t><w:br w:type="page"/><w:br w:type="page"/></w:r></w:p><w:p><w:pPr><w:x><w:pageBreakBefore/></w:x></w:pPr><w:r><w:t>two</w:t></w:r></w:p><w:tbl/></w:body></w:document>')
    assert uploads.docx_units(docx) == [("one", 1, "p"), ("two", 3, "p"), ("", 3, "tbl")]
    s = 'xmlns="http://schemas.openxmlformats.org/spreadsheetml/2006/main" xmlns:r="http://schemas.openxmlformats.org/officeDocument/2006/relationships"'
    xlsx = zipped(
        xl__workbook_dot_xml=f'<workbook {s}><sheets><sheet name="Prices" r:id="r1"/></sheets></workbook>', xl___rels__workbook_dot_xml_dot_rels='<Relationships xmlns="http://schemas.openxmlformats.org/package/2006/relationships"><Relationship Id="r1" Target="worksheets/sheet1.xml"/></Relationships>',
        xl__sharedStrings_dot_xml=f"<sst {s}><si><t>name</t></si><si><t>pear</t></si></sst>", xl__worksheets__sheet1_dot_xml=f'<worksheet {s}><sheetData><row><c r="A1" t="s"><v>0</v></c><c r="C1" t="inlineStr"><is><t>cost</t></is></c></row><row><c r="A2" t="s"><v>1</v></c><c r="C2"><v>3.5</v></c></row></sheetData></worksheet>',
    )
    assert uploads.parse_file(xlsx, "xlsx") == [("heading", 1, "Prices"), ("table", None, "name: pear | cost: 3.5")]
    p = 'xmlns:a="http://schemas.openxmlformats.org/drawingml/2006/main" xmlns:p="http://schemas.openxmlformats.org/presentationml/2006/main"'
    shape = lambda kind, t: f'<p:sp><p:nvSpPr><p:nvPr>{kind}</p:nvPr></p:nvSpPr><p:txBody><a:p><a:r><a:t>{t}</a:t></a:r></a:p></p:txBody></p:sp>'
    slide = lambda t: f"<p:sld {p}><p:cSld><p:spTree>{shape('<p:ph type=\"title\"/>', t)}{shape('', 'body of ' + t)}</p:spTree></p:cSld></p:sld>"
    pptx = zipped(ppt__slides__slide10_dot_xml=slide("ten"), ppt__slides__slide2_dot_xml=slide("two"))
    assert uploads.parse_file(pptx, "pptx") == [("heading", 1, "two"), ("paragraph", None, "body of two"), ("heading", 1, "ten"), ("paragraph", None, "body of ten")]
    stream = zlib.compress(b"BT /F1 12 Tf (Hello \\(you\\)) Tj 0 -14 Td [(sec) -20 (ond)] TJ T* <4142> Tj ET")
    pdf = b"%%PDF-1.4\n1 0 obj <</Length %d /Filter /FlateDecode>>\nstream\n%s\nendstream endobj" % (len(stream), stream)
    assert [t for _, _, t in uploads.parse_file(pdf, "pdf")] == ["Hello (you)", "second", "AB"]
    assert uploads.parse_file(b"no zip", "docx") == [] and uploads.parse_file(None, "pdf") == []
    assert [i[0] for i in uploads.parse("# T\n\ntext\n- a\n- b\n", "md")] == ["heading", "paragraph", "list_item", "list_item"]
    assert uploads.parse("a,b\n1,2\n", "csv") == [("table", None, "a: 1 | b: 2")]
    page = "<head><title>no</title></head><h2>Top &amp; more</h2><p>first<br>second <b>bold</b></p><script>x</script><ul><li>item</ul><table><tr><td>cell</td></tr></table>"
    assert uploads.parse(page, "html") == [("heading", 2, "Top & more"), ("paragraph", None, "first"), ("paragraph", None, "second bold"), ("list_item", None, "item"), ("paragraph", None, "cell")]
    files = spark.createDataFrame([(1, "docx", bytearray(docx)), (2, "html", bytearray(page.encode())), (3, "pdf", None)], "document_id long, kind string, content binary")
    assert [(r["document_id"], r["text"]) for r in uploads.parsed(files).orderBy("document_id", "ordinal").limit(3).collect()] == [(1, "one"), (1, "two"), (2, "Top & more")]


def test_download_names(spark):
    df = spark.createDataFrame([("a b~(1)*é.pdf",)], "n string")
    want = urllib.parse.quote("a b~(1)*é.pdf")
    assert df.select(uploads.attachment(F.col("n"))).first()[0] == f"attachment; filename=\"{want}\"; filename*=UTF-8''{want}"


def test_chunk_files_are_all_or_nothing(spark):
    rows = [(1, '{"chunk_id": "a"}'), (1, '{"chunk_id": "b"}'), (2, '{"chunk_id": "c"}'), (2, "{oops"), (3, '{"text": "x"}')]
    got = artifacts.readable_chunks(spark.createDataFrame(rows, "file long, value string"), "chunk_id string")
    assert sorted(r["chunk_id"] for r in got.collect()) == ["a", "b"]


def test_publish_reuse_and_guard(spark, tmp_path):
    df = spark.createDataFrame([("c1", "t"), ("c2", "u")], "chunk_id string, text string").withColumn("v", F.array(F.lit(1.0)))
    root = f"file://{tmp_path}/snap"
    with pytest.raises(artifacts.SnapshotError, match="not_published"):
        artifacts.read_snapshot(spark, root)
    first = snapshot.publish(df, df.limit(1), root)
    second = snapshot.publish(df.limit(1), df.limit(1), root)
    assert first != second and artifacts.read_snapshot(spark, root).count() == 1 and artifacts.read_manifest(spark, root).count() == 1
    shutil.rmtree(tmp_path / "snap" / second)
    with pytest.raises(artifacts.SnapshotError, match="version_missing"):
        artifacts.read_snapshot(spark, root)
    with pytest.raises(ValueError):
        snapshot.guarded_output("/a/data/x", "/a/data")
    got = snapshot.reuse_vectors(spark.createDataFrame([("c1", "t"), ("c9", "z")], "chunk_id string, text string"), df, vectors.hashed_bow)
    assert {r["chunk_id"]: r["reused"] for r in got.collect()} == {"c1": True, "c9": False}


def test_full_build(spark, tmp_path):
    from lexiforge.operators import build
    from lexiforge.plans.elements import elements as of_lines

    rows = of_lines(spark, SMALL).where("document_id < 40").cache()
    docs = rows.select("document_id").distinct().withColumn("revision", F.lit("r1"))
    root = f"file://{tmp_path}/b"
    build.build(docs, rows, root, {}, vectors.hashed_bow, buckets=8)
    state = build.published(spark, root)
    got = {r["document_id"]: r["n"] for r in build.read_chunks(spark, state).where("chunk_type = 'prose'").groupBy("document_id").agg(F.count(F.lit(1)).alias("n")).collect()}
    want = {r["document_id"]: r["n"] for r in chunks.prose_chunks(rows).groupBy("document_id").agg(F.count(F.lit(1)).alias("n")).collect()}
    assert got == want and len(build.read_documents(spark, state).collect()) == docs.count()


def test_cache_follows_version_and_time(spark):
    now = [0.0]
    c = cache.VersionedCache(ttl_s=10, size=2, clock=lambda: now[0])
    build = lambda: spark.range(3)
    a = c.get("a", 1, build)
    assert c.get("a", 1, build) is a and a.is_cached
    assert c.get("a", 2, build) is not a and (c.hits, c.misses) == (1, 2)
    now[0] = 11
    c.get("a", 2, build)
    assert c.misses == 3
    c.get("b", 1, build), c.get("c", 1, build), c.get("a", 2, build)
    assert c.misses == 6
    c.clear()


def test_migrations_add_columns(spark, tmp_path):
    root = f"file://{tmp_path}/state"
    assert migrations.migrate(spark, root) == 3 and migrations.read_table(spark, root, "sessions").columns == ["session_id", "updated_at", "scope_json", "summary_failures"]
    old = spark.createDataFrame([(1, "x")], "session_id long, updated_at string")
    migrations.store_tables(spark, root, {"sessions": old}, 1)
    assert migrations.migrate(spark, root) == 3 and migrations.stored_version(spark, root) == 3
    assert [tuple(r) for r in migrations.read_table(spark, root, "sessions").collect()] == [(1, "x", None, 0)]


def test_summaries_are_made_batch_by_batch(spark, tmp_path):
    messages = spark.createDataFrame([(s, k, f"m{k}") for s, n in ((1, 20), (2, 5), (3, 20)) for k in range(1, n + 1)], "session_id long, id long, text string")
    sessions = spark.createDataFrame([(1, None, 0, 2), (2, None, 0, 0), (3, "old", 2, 3)], "session_id long, summary string, covered long, failures int")
    messages.select("session_id").write.parquet(f"{tmp_path}/in")
    made = []
    summarize = lambda t: t.select("session_id", F.array_join("texts", "+").alias("new_summary"))
    writer = summaries.stream_summaries(spark.readStream.schema("session_id long").parquet(f"{tmp_path}/in"), lambda: (messages, sessions), lambda df, n: made.extend(map(tuple, df.collect())), summarize, f"{tmp_path}/cp")
    writer.trigger(availableNow=True).start().awaitTermination()
    assert sorted(made) == [(1, "+".join(f"m{k}" for k in range(1, 9)), 8, 0), (2, None, 0, 0), (3, "old", 2, 3)]
    failed = summaries.summarized(messages, sessions, lambda t: t.select("session_id", F.lit(" ").alias("new_summary")))
    assert {r["session_id"]: r["failures"] for r in failed.collect()} == {1: 3, 2: 0, 3: 3}


def test_settings_and_promotion(spark):
    rows = spark.createDataFrame([(0, 2.0, "fast", True, " "), (5, 0.5, "auto", False, "")], "top_k int, score_floor_ratio double, route_mode string, rerank_enabled boolean, rerank_model string")
    assert [r["violations"] for r in settings.with_violations(rows).collect()] == [["top_k", "score_floor_ratio", "route_mode", "rerank_model"], []]
    kinds = [("preference", "k", 1), ("progress", "next_step", None), ("progress", "next_step", 1), ("progress", "odd", 1), ("profile", "odd", None), ("other", "k", 1)]
    df = spark.createDataFrame([(*k, "pending") for k in kinds], "kind string, key string, collection_id long, status string")
    assert [(r["target"], r["field"], r["status"]) for r in state.promoted(df).collect()] == [("preferences", "k", "confirmed"), (None, None, "confirmed"), ("progress", "next_step", "confirmed"), (None, None, "confirmed"), ("profile", "goal", "confirmed"), (None, None, "confirmed")]
    labels = spark.createDataFrame([(2, 3, "page"), (2, 2, None), (2, 9, "slide"), (2, None, "section"), (None, 1, "page")], "p int, e int, k string")
    assert [r[0] for r in labels.select(state.page_label(F.col("p"), F.col("e"), F.col("k"))).collect()] == ["p2-3", "p2", "slide 2", "§2", ""]
    said = spark.createDataFrame([("Yes",), ("0",), ("2",), ("no",), (None,), (" TRUE ",)], "t string")
    assert [r[0] for r in said.select(state.truthy(F.col("t"))).collect()] == [True, False, True, False, False, True]


def test_tool_loop_gate(spark):
    def ended(mode, material, steps):
        rows = [(1, k, mode, material, s == "a", s in "se", s == "e") for k, s in enumerate(steps)]
        r = turns.replay(spark.createDataFrame(rows, "turn_id long, round int, mode string, material boolean, answered boolean, searched boolean, evidence boolean")).first()
        return r["reason"], r["rounds"], r["blocks"]

    assert ended("deep", True, "aa") == ("no_evidence_after_gate", 2, 2) and ended("deep", False, "a") == ("answered", 1, 0)
    assert ended("deep", True, "asea") == ("answered", 4, 1) and ended("chat", True, "aa") == ("answered", 2, 1)
    assert ended("chat", True, "sa") == ("answered", 2, 0) and ended("deep", True, "ssssssa") == ("max_steps_without_answer", 6, 0)
    assert ended("chat", True, "s") == ("open", 1, 0)


def test_state_updates(spark):
    old = spark.createDataFrame([(1, "a", 1), (2, "b", 2)], "k int, x string, y int")
    new = spark.createDataFrame([(2, None, 9), (3, "c", None)], "k int, x string, y int")
    assert sorted(map(tuple, state.upsert(old, new, ["k"], ["x", "y"]).collect())) == [(1, "a", 1), (2, "b", 9), (3, "c", None)]


def test_metrics(spark):
    ranks = spark.createDataFrame([(1, 1, 3), (1, 2, None), (2, 1, 9)], "question int, target int, rank int")
    row = evaluate.retrieval_summary(ranks, 50).first()
    assert (row["recall_5"], row["recall_10"], row["median_rank"]) == (0.5, 1.0, 6.0)
    cover = spark.createDataFrame([("6, 512 and 8", "512 of 6"), ("none", "1")], "a string, b string")
    assert [r[0] for r in cover.select(evaluate.number_coverage(F.col("a"), F.col("b"))).collect()] == [0.667, None]


def test_routing(spark):
    q = spark.createDataFrame([("注意力机制是什么，编码器怎么训练",), ("short",), ("训练集在第3节里面吗",)], "q string")
    assert [r[0] for r in q.select(route.track(F.col("q"), F.lit(0))).collect()] == ["planned", "direct", "planned"]


def test_stream_equals_batch(spark, tmp_path):
    from lexiforge.plans.live import events

    src, kinds = events(spark, SMALL), F.col("event")
    ended = src.withColumn("event", F.when(F.col("seq") % 97 == 0, "turn_end").otherwise(kinds))
    ended.write.parquet(f"{tmp_path}/in")
    stream = turns.stream_turns(spark.readStream.schema(ended.schema).parquet(f"{tmp_path}/in"), ping=False)
    q = stream.writeStream.format("memory").queryName("turns_out").outputMode("append").trigger(availableNow=True).option("checkpointLocation", f"{tmp_path}/cp").start()
    q.awaitTermination()
    done = sorted(map(tuple, spark.table("turns_out").collect()))
    assert done and done == sorted(tuple(r) for r in turns.turns(ended).collect() if r["state"] != "open")


def test_partial_answers_and_frames(spark):
    cases = {'{"answer": "a\\n\\"b': 'a\n"b', '{"answer": "x\\u00': "x", "{}": "", '{"a": 1, "answer": "done", "b": "x"}': "done", '{"answer": "back\\\\': "back\\", '{"answer": "cut\\': "cut", '{"answer": "line\nbreak': "line\nbreak", '{"answer": "\\u00e9"}': "é"}
    df = spark.createDataFrame([(c,) for c in cases], "r string")
    assert [r[0] for r in df.select(turns.partial_answer(F.col("r"))).collect()] == list(cases.values())
    raw = ": hi\n\nevent: a\ndata: 1\n\nevent: b\n\nevent: c\r\ndata: 2\r\n\r\n"
    got = spark.createDataFrame([(raw,)], "r string").select(turns.frames(F.col("r"))).first()[0]
    assert [(f["event"], f["data"]) for f in got] == [("a", "1"), ("c", "2")]


def test_plans_keep_their_shape(spark):
    from lexiforge import catalog

    plan = catalog.queries()["L1_top_k_per_query"](spark, SMALL)._jdf.queryExecution().executedPlan().toString()
    assert "WindowGroupLimit" in plan and "CartesianProduct" not in plan
    plan = catalog.queries()["U1_scope_union"](spark, SMALL)._jdf.queryExecution().executedPlan().toString()
    assert "PushedFilters: [IsNotNull(source), EqualTo(source,src0)]" in plan


def test_plans_have_no_cross_joins_or_whole_table_windows(spark):
    from lexiforge import catalog

    for name in ("Q9_lexical_rerank", "V3_token_budget_batches", "S15_question_reader", "C18_neighbor_binding", "A5_percentile_half_even", "J21_filename_fallback"):
        plan = catalog.queries()[name](spark, SMALL)._jdf.queryExecution().executedPlan().toString()
        assert "CartesianProduct" not in plan, name
    plan = catalog.queries()["X3_turn_reducer"](spark, SMALL)._jdf.queryExecution().executedPlan().toString()
    assert "Pandas" not in plan and plan.count("Exchange hashpartitioning") == 1
    assert "Python" not in catalog.queries()["E6_fragment_merge"](spark, SMALL)._jdf.queryExecution().executedPlan().toString()


def test_packed_tables_are_made_once(spark):
    from lexiforge import catalog

    plan = catalog.queries()["C11_tables_packed"](spark, SMALL)._jdf.queryExecution().executedPlan().toString()
    assert "lineitem" not in plan and "Window" not in plan


def test_sql_belongs_to_queries():
    from lexiforge import catalog

    assert len(catalog.queries()) > 250 and set(catalog.oracles()) <= set(catalog.queries())


@pytest.mark.parametrize("name", ["C5_greedy_merge", "E9_heading_stack_path", "X6_tool_loop", "Q5_quota_selection", "R9_table_facts"])
def test_queries_equal_their_sql(spark, name):
    from lexiforge import catalog

    con = duckdb.connect()
    for path in glob.glob(f"{SMALL}/*.parquet"):
        con.execute(f"CREATE VIEW {os.path.basename(path)[:-8]} AS SELECT * FROM read_parquet('{path}')")
    want = con.execute(catalog.oracles()[name])
    columns = [c[0] for c in want.description]
    got = catalog.queries()[name](spark, SMALL).select(*columns).collect()
    assert sorted(map(repr, map(tuple, got))) == sorted(map(repr, want.fetchall()))
