"""Documents with every awkward case, for the tests of all corpus operators."""

import random
import re

SCHEMA = "doc_id BIGINT, text STRING, lang STRING, source STRING, n_chars BIGINT, copies INT, `size` STRING, digest STRING, item STRING, r STRING"
LOWER = str.maketrans("ABCDEFGHIJKLMNOPQRSTUVWXYZ", "abcdefghijklmnopqrstuvwxyz")


def prose(seed, words=60):
    pick = random.Random(seed)
    parts = ["an", "ber", "cio", "du", "el", "fo", "gra", "hi", "ju", "ka", "é", "ü"]
    return " ".join("".join(pick.choice(parts) for _ in range(pick.randint(1, 4))) for _ in range(words))


def row(doc_id, text, source="s1", lang="en"):
    """Columns beyond the table's own bear names that the operators use inside."""
    return (doc_id, text, lang, source, None if text is None else len(text), 7, "size", "digest", "item", "r")


def rows():
    out = [row(k, prose(k), f"s{k % 3}") for k in range(40)]
    base = prose(100, 120).split()
    for k in range(8):  # near copies of each other
        words = list(base)
        words[10 * k] = "changed"
        out.append(row(100 + k, " ".join(words), "s0"))
    out += [row(200 + k, "A line that many share\n" + prose(500 + k, 20) + "\n  a LINE that many share ") for k in range(14)]
    out += [row(300 + k, "exactly the same text here", f"s{k % 2}") for k in range(30)]
    out += [row(400, None), row(401, ""), row(402, " \n\t\n"), row(403, "\n"), row(404, "word"), row(405, "WORD"), row(406, "two words")]
    out += [row(407, "x " * 30000 + "end"), row(408, "long" * 20000), row(409, prose(9, 8000))]
    out += [row(None, prose(3)), row(None, None), row(None, "no id")]
    out += [row(5, prose(5)), row(5, prose(5)), row(6, "another text of the same id"), row(410, prose(77), None, None)]
    out += [row(411, "Straße ſecret İstanbul K é é\r\nzwei\x0bdrei\x85vier fünf\x1cend"), row(412, "\x00 null byte <|endoftext|> end")]
    return out


def documents(spark, data=None):
    return spark.createDataFrame(rows() if data is None else data, SCHEMA).repartition(5)


def empty(spark):
    return spark.createDataFrame([], SCHEMA)


def words(text):
    """Words between ASCII white space, A-Z lower-cased."""
    return re.findall("[^\x20\x09-\x0d]+", (text or "").translate(LOWER))
