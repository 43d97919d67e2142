import random
import re

SPACE = "\x20\t\n\x0b\x0c\r"
DOC = "doc_id long, text string, lang string, source string, n_chars long"


def words(text):
    return re.findall(r"[^\x20\x09-\x0D]+", text or "")


def frame(spark, rows, extra=False):
    """rows (doc_id, text, source); with extra, a column whose name clashes with the operators' own."""
    data = [(d, t, "en", s, len(t or "")) for d, t, s in rows]
    df = spark.createDataFrame(data, DOC)
    if extra:
        from pyspark.sql import functions as F

        df = df.withColumns({c: F.lit("clash") for c in ("size", "h", "digest", "node", "n", "label", "kept", "b", "target", "set", "id")})
    return df


def odd_rows():
    """Nulls, empty and blank texts, repeats, ties and a long text."""
    long = " ".join(f"w{k % 3000}" for k in range(30_000))
    body = " ".join(f"v{k}" for k in range(60))
    return [
        (1, None, "a"), (2, "", "a"), (3, " \t\n", None), (4, "one", "b"), (5, "one two", "b"), (6, body, "a"), (7, body.replace(" ", "  "), "c"),
        (7, body.replace(" ", "  "), "c"), (8, body + " extra", "a"), (9, long, "a"), (None, body, None), (None, "alone", "b"), (10, body + "\n" + body, "c"),
    ]


def text_maker(seed):
    rnd = random.Random(seed)
    vocabulary = [f"{a}{b}" for a in "bcdfgklmnprst" for b in "aeiou"]

    def make(n):
        return " ".join(rnd.choice(vocabulary) + rnd.choice(vocabulary) for _ in range(n))

    return rnd, make


class Union:
    def __init__(self):
        self.up = {}

    def find(self, x):
        self.up.setdefault(x, x)
        while self.up[x] != x:
            self.up[x] = self.up[self.up[x]]
            x = self.up[x]
        return x

    def join(self, a, b):
        a, b = self.find(a), self.find(b)
        self.up[max(a, b)] = min(a, b)
