import random
import re
from collections import Counter

import numpy as np
import pyarrow as pa
import pytest

from lexiforge.llm import ans, boosting, minhash, packing, quality, tokens, warc
from lexiforge.llm.html_extract import extract, induce


def test_statistics_match_plain_counts():
    rnd = random.Random(1)
    texts = ["".join(rnd.choice(["a", "b", "é𝒳", "#", "\n", "\n", " ", "\t", "\x0b", "\x1c", "a b c "]) for _ in range(rnd.randrange(120))) for _ in range(300)] + [""]
    got = quality.statistics(pa.array(texts))
    for i, t in enumerate(texts):
        w = re.findall(r"[^\x20\x09-\x0D]+", t)
        windows = Counter(tuple(w[k : k + 3]) for k in range(len(w) - 2))
        covered = {k + j for k in range(len(w) - 2) if windows[tuple(w[k : k + 3])] > 1 for j in range(3)}
        seen, dup = set(), 0
        for line in t.split("\n"):
            if re.search(r"[^\x20\x09-\x0D]", line):
                dup += line in seen
                seen.add(line)
        want = (len(w), sum(map(len, w)), sum(c in "#*$%&|<>" for c in t), dup, len(covered))
        assert tuple(int(got[c][i]) for c in quality.COUNTS) == want, t


def test_trees_learn_and_keep_their_constraints():
    rng = np.random.default_rng(0)
    x = rng.random((3000, 3))
    y = ((x[:, 0] < 0.4) | (x[:, 1] > 0.8)).astype(float)
    forest = boosting.fit(x[:2000], y[:2000], np.array([-1, 1, 0]))
    assert ((forest.probability(x[2000:]) > 0.5) == y[2000:]).mean() > 0.95
    for f, sign in ((0, -1), (1, 1)):
        low, high = x.copy(), x.copy()
        high[:, f] += rng.random(len(x))
        assert (sign * (forest.margin(high) - forest.margin(low)) >= -1e-9).all()


def test_encoder_gives_the_library_ids():
    rnd = random.Random(5)
    parts = ["a", "B", "é", "É", "'", "s", "t", "'S", "'ll", ".", ",", "!", "(", "1", "½", "̱", "̈", "I", "<|", "endoftext", "|>", " ", " ", "\n", "日", "×", "-", "\xa0", "\x1c"]
    texts = ["".join(rnd.choice(parts) for _ in range(rnd.randrange(60))) for _ in range(3000)] + [""]
    e = tokens.Encoder(tokens.default_path(), max_pieces=500)
    ids, bounds = e.encode(pa.array(texts), 0)
    again, _ = e.encode(pa.array(texts), 0)
    assert (ids == again).all()
    for i, r in enumerate(e.tokenizer.encode_batch(texts, add_special_tokens=False)):
        assert ids[bounds[i] : bounds[i + 1]].tolist() == [*r.ids, 0]


def test_letter_stems_are_encoded_many_at_a_time():
    rnd = random.Random(8)
    e = tokens.Encoder(tokens.default_path())
    plain, given = e.tokenizer, []

    class Counted:
        def encode_batch_fast(self, texts, **how):
            given.extend(texts)
            return plain.encode_batch_fast(texts, **how)

    e.tokenizer = Counted()
    letters = "abcdefgxyzßäéñøĄłŉƀȺɏ"
    odd = ["İx", "a\u0301b", "\u0958", "x9", "don't", "ªa", "a×b", "日本", "ʰa", "<|endoftext|>", "ﬁx", "ς", "\u200bq", "A" * 5000]
    stems = ["".join(rnd.choice(letters + letters.upper()) for _ in range(rnd.randint(1, 12))) for _ in range(2000)] + odd
    rnd.shuffle(stems)
    texts = [" ".join(stems[k : k + 7]) for k in range(0, len(stems), 7)]
    want = [x for t in texts for x in [*plain.encode(t, add_special_tokens=False).ids, 2]]
    assert e.encode(pa.array(texts), 2)[0].tolist() == want
    assert len(given) < len(stems) / 4
    # Where no id tells the end of a word, each is encoded by itself.
    e = tokens.Encoder(tokens.default_path())
    e.ends[:] = False
    assert e.encode(pa.array(texts), 2)[0].tolist() == want


def test_every_letter_with_every_ending_has_the_library_ids():
    letters = [chr(k) for k in range(0xC0, 0x250)]
    texts = [f"{a}{x}{b}{e}" for x in letters for e in [*tokens.ENDINGS, "...", "?!"] for a, b in (("", ""), ("val", ""), ("", "i"), (x, x))]
    texts += [f"VALİLİĞİ{e} İstanbul{e} İ{e}{e} Iİ{e}" for e in tokens.ENDINGS]
    rnd = random.Random(6)
    texts += ["".join(rnd.choice([*"İIıiaZ9é \u0307", *tokens.ENDINGS]) for _ in range(40)) for _ in range(3000)]
    e = tokens.Encoder(tokens.default_path())
    ids, bounds = e.encode(pa.array(texts), 0)
    for i, r in enumerate(e.tokenizer.encode_batch(texts, add_special_tokens=False)):
        assert ids[bounds[i] : bounds[i + 1]].tolist() == [*r.ids, 0], texts[i]


@pytest.mark.parametrize("n", [0, 1, 63, 64, 65, 16384, 65535, 65536, 65537, 200_000])
def test_ans_round_trip(n):
    ids = np.minimum(np.random.default_rng(n).zipf(1.3, max(n, 1)), 49_407).astype(np.uint32)
    table = ans.Table.from_bytes(ans.Table.of_counts(*np.unique(ids, return_counts=True)).to_bytes())
    assert (ans.decode_blocks(ans.encode_blocks(ids[:n], table), table) == ids[:n]).all()


def test_ans_notices_damage():
    ids = np.arange(5000, dtype=np.uint32) % 300
    table = ans.Table.of_counts(*np.unique(ids, return_counts=True))
    raw = bytearray(ans.encode_blocks(ids, table)[0])
    raw[len(raw) // 2] ^= 1
    with pytest.raises(ans.CorruptBlock):
        ans.decode_blocks([bytes(raw)], table)


@pytest.mark.parametrize("low,high", [(1, 2048), (700, 1500), (1500, 1500), (600, 1400)])
def test_packing_is_valid_and_near_its_bound(low, high):
    rnd = random.Random(low)
    lengths = [rnd.randint(low, high) for _ in range(1500)]
    bins, offset, full = packing.pack(lengths)
    by_bin = {}
    for p, (b, o) in enumerate(zip(bins, offset, strict=True)):
        by_bin.setdefault(int(b), []).append((int(o), lengths[p], bool(full[p])))
    for pieces in by_bin.values():
        at = 0
        for o, n, _ in sorted(pieces):
            assert o == at
            at += n
        assert at <= packing.CAPACITY and all(f == (at == packing.CAPACITY) for *_, f in pieces)
    assert sorted(by_bin) == list(range(len(by_bin)))


def test_local_search_empties_a_bin():
    lengths = [6, 5, 4, 3, 3, 3]
    bins = packing.Bins(12)
    for group in ([6, 5], [4, 3, 3], [3]):
        b = bins.open()
        for n in group:
            p = next(k for k, length in enumerate(lengths) if length == n and all(k not in q for q in bins.pieces))
            bins.put(b, p, n)
    assert sum(bool(p) for p in packing.local_search(bins, lengths).pieces) == 2


def test_superminhash_is_the_element_wise_one():
    for n in (1, 2, 40, 300):
        values = np.unique(np.random.default_rng(n).integers(0, 2**63, n).astype(np.uint64))
        got = minhash.superminhash(values, np.array([0, len(values)]), 25)[0].tolist()
        want = [None] * 25
        for x in values:
            place = list(range(25))
            for j in range(25):
                z = minhash.mix(np.array([x]) + np.uint64(j + 1) * np.uint64(0x342543DE82EF95))
                k = j + int(minhash.mix(z)[0] % np.uint64(25 - j))
                place[j], place[k] = place[k], place[j]
                v = (j << 53) | int(z[0] >> np.uint64(11))
                if want[place[j]] is None or v < want[place[j]]:
                    want[place[j]] = v
        assert got == want


def test_signatures_estimate_jaccard():
    rng = np.random.default_rng(3)
    a = np.unique(rng.integers(0, 2**63, 400).astype(np.uint64))
    b = np.unique(np.concatenate([a[:300], rng.integers(0, 2**63, 100).astype(np.uint64)]))
    both = np.concatenate([a, b])
    for make in (minhash.superminhash, minhash.minhash):
        sig = make(both, np.array([0, len(a), len(both)]), 400)
        true = len(np.intersect1d(a, b)) / len(np.union1d(a, b))
        assert abs((sig[0] == sig[1]).mean() - true) < 0.1


PAGE = """<html><head><title>t</title></head><body><header><h1>Site</h1></header><div class="menu"><a href=x>Home</a></div>
<div id="cookie-notice">We use cookies</div><div class="content"><h1>Title {0}</h1><p>First   para {0} with <b>bold</b>text &amp; more<span class="ad">BUY {0}</span></p>
<p>Line {0}<br>next &eacute;{0}<form><input>Subscribe {0}</form><section class="comments"><p>great {0} post</p></section></div>
<div class="related"><a>other {0}</a></div><p class=foot>Terms constant</p><footer>(c) {0}</footer><script>var x = "<p>no</p>"</script></body></html>"""


def test_wrapper_induction_keeps_the_article():
    pages = [PAGE.format(k * 7919) for k in range(1, 5)]
    w = induce(pages)
    assert w["root"].endswith("div.content")
    assert extract(pages[1], [w]) == "Title 15838 First para 15838 with boldtext & more Line 15838 next é15838"
    assert extract(PAGE.format(5), [w]).startswith("Title 5 First para 5")
    assert extract("", [w]) == "" and extract("just words", []) == "just words"


def test_extraction_stands_broken_markup():
    for page in ("<p", "<a href='x>y", "</div></div>text", "<article><p>one<p>two", "<!-- open", "<script>never closed", "<b><p>x</b></p>&amp", "<" * 3000):
        assert isinstance(extract(page, []), str)
    assert extract("<article><p>one<p>two", []) == "one two"


def test_warc_records_parse_and_resync():
    def rec(page, body):
        return f"WARC/1.1\r\nWARC-Record-ID: <urn:page:{page}>\r\nContent-Length: {len(body)}\r\n\r\n".encode() + body + b"\r\n\r\n"

    data = rec(1, b"abc") + rec(2, b"WARC/1.1 inside\r\n\r\n") + rec(3, b"")
    rows = list(warc.parse(data))
    assert [p for *_, p in rows] == [1, 2, 3] and sum(n for _, n, _ in rows) == len(data)
    broken = data.replace(b"Content-Length: 3", b"Content-Length: 9")
    rows = list(warc.parse(broken))
    assert [p for *_, p in rows][1:] == [2, 3] and sum(n for _, n, _ in rows) == len(data)
    leaves = {k: bytes([k]) for k in range(40)}
    changed = {**leaves, 33: b"x"}
    a, b = warc.tree(leaves), warc.tree(changed)
    differ = {(level, k) for (level, k, h), (*_, g) in zip(a, b, strict=True) if h != g}
    assert differ == {(0, 33), (1, 2), (2, 0)}
