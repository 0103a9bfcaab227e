"""Vector codes, licence templates and periodic runs against plain versions, and their edge cases."""

import hashlib
import math
import random
import re
import zlib

import numpy as np
import pytest

from tallyloom.llm import licenses, periodic_runs, vector_codes

VECTORS = "vec_id long, embedding array<float>, label int"


def lloyd(rows):
    """code and error of each kept row, and the digest, by plain scans over Python integers."""
    kept = [(i, [math.floor(4096 * x) for x in v], label) for i, v, label in rows if v is not None and all(x is not None and math.isfinite(x) for x in v)]
    least = {}
    for i, v, _ in kept:
        if i is not None:
            least[i] = min(v, least.get(i, v))
    width = len(kept[0][1]) // 8
    cut = lambda v, p: v[p * width : (p + 1) * width]
    books = [[cut(least[i], p) for i in sorted(least)[:16]] for p in range(8)]
    near = lambda x, book: min((sum((a - b) ** 2 for a, b in zip(x, c, strict=True)), j) for j, c in enumerate(book))
    for _ in range(6):
        for p in range(8):
            parts = [cut(v, p) for _, v, _ in kept]
            to = [near(x, books[p])[1] for x in parts]
            for j in range(len(books[p])):
                mine = [x for x, k in zip(parts, to, strict=True) if k == j]
                if mine:
                    books[p][j] = [sum(c) // len(mine) for c in zip(*mine, strict=True)]
    out = []
    for i, v, label in kept:
        found = [near(cut(v, p), books[p]) for p in range(8)]
        out.append((i, "".join(f"{j:02x}" for _, j in found), sum(d for d, _ in found), label))
    return out, hashlib.sha256(",".join(str(x) for book in books for c in book for x in c).encode()).hexdigest()


def coded(spark, rows):
    got = vector_codes.code_vectors(spark.createDataFrame(rows, VECTORS).repartition(3))
    return [tuple(r) for r in got.collect()]


@pytest.mark.parametrize("seed", range(3))
def test_vector_codes_equal_plain_lloyd(spark, seed, monkeypatch):
    rng = random.Random(seed)
    monkeypatch.setattr(vector_codes, "BLOCK_ROWS", 64)
    grid = seed == 1  # few values: many ties and equal entries
    value = lambda: rng.choice([-0.5, 0.0, 0.25]) if grid else rng.gauss(0, 0.3)
    rows = [(i, [value() for _ in range(16)], rng.choice([None, 0, 1])) for i in range(300)]
    rows += rows[:40] + [(5, [value() for _ in range(16)], 1), (None, [value() for _ in range(16)], 0)]
    rows += [(900, None, 1), (901, [None] + [0.0] * 15, 1), (902, [float("nan")] * 16, 1), (903, [float("inf")] * 16, None)]
    want, digest = lloyd(rows)
    sums = {}
    for _, _, error, label in want:
        sums[label] = sums.get(label, 0) + error
    assert sorted(coded(spark, rows), key=str) == sorted(((i, c, e, sums[label], digest) for i, c, e, label in want), key=str)


def test_vector_codes_small_tables(spark):
    assert coded(spark, []) == [] and coded(spark, [(1, None, 1)]) == [] and coded(spark, [(None, [0.5] * 8, 1)]) == []
    few = [(3, [0.1 * k for k in range(8)], 1), (1, [-0.1 * k for k in range(8)], None), (1, [-0.1 * k for k in range(8)], None)]
    want, digest = lloyd(few)
    assert {(r[0], r[1], r[2]) for r in coded(spark, few)} == {x[:3] for x in want} and coded(spark, few)[0][4] == digest
    with pytest.raises(ValueError):
        coded(spark, [(1, [0.5] * 12, 1)])
    with pytest.raises(Exception, match="differ in length"):
        coded(spark, [(i, [0.5] * (8 if i < 17 else 16), 1) for i in range(40)])
    with pytest.raises(Exception, match="too large"):
        coded(spark, [(1, [1e30] * 8, 1)])
    clash = spark.createDataFrame(few, VECTORS).selectExpr("*", "1 AS code", "2 AS a", "3 AS _salt", "4 AS _spread", "5 AS moved")
    assert vector_codes.code_vectors(clash).count() == 3


def test_vector_codes_shuffled_label_sums(spark, monkeypatch):
    monkeypatch.setattr(vector_codes, "BROADCAST_LABELS", 3)
    rows = [(i, [(i * k % 7) / 10 for k in range(8)], None if i < 40 else i) for i in range(60)]
    sums = {}
    want, _ = lloyd(rows)
    for _, _, error, label in want:
        sums[label] = sums.get(label, 0) + error
    assert {(r[0], r[3]) for r in coded(spark, rows)} == {(i, sums[label]) for i, _, _, label in want}


def test_bounds_leave_no_part_behind():
    """After many moves a part's bounds still hold, and equal entries give the lower index."""
    rng = np.random.default_rng(7)
    x = rng.integers(-3, 4, (400, 2))
    books = vector_codes.Codebooks(rng.integers(-3, 4, (1, 6, 2)))
    a, u, low = books.scan(0, x)
    for _ in range(12):
        books = vector_codes.Codebooks(books.entries + rng.integers(-1, 2, (1, 6, 2)), books.entries)
        a, u, low = books.update(0, x, a, u, low)
        d = ((x[:, None] - books.entries[0][None]) ** 2).sum(-1)
        assert (a == d.argmin(1)).all()
        assert (u.astype(float) ** 2 >= d.min(1) - 1e-9).all()
        rest = np.sort(d, 1)[:, 1]
        assert (np.maximum(low, 0).astype(float) ** 2 <= rest + 1e-9).all()


def template(text, words):
    machine = licenses.Automaton("x", 1.0, licenses.parse(text))
    return machine.accepts([w.encode() for w in words.split()], f" {words} ".encode())


def test_template_regions():
    t = "keep this <<beginOptional>>maybe <<beginOptional>>also<<endOptional>> that<<endOptional>> then <<var;match=.{1,2}>> or <<var;match=red|dark blue>> end"
    assert template(t, "x keep this then a or red end y")
    assert template(t, "keep this maybe that then a b or dark blue end")
    assert template(t, "keep this keep this maybe also that then or or red end")
    assert not template(t, "keep this also that then a or red end")
    assert not template(t, "keep this maybe that then or red end")
    assert not template(t, "keep this then a b c or red end")
    assert not template(t, "keep this then a or blue end") and not template(t, "keep this then a or red")
    for bad in ("<<beginOptional>>a<<endOptional>>", "a <<beginOptional>> b", "a <<endOptional>> b"):
        with pytest.raises(ValueError):
            licenses.Automaton("x", 1.0, licenses.parse(bad))


def test_automata_equal_regular_expressions():
    """Random templates over three words against the same templates as regular expressions."""
    rng = random.Random(3)

    def items(depth):
        made = []
        for _ in range(rng.randint(1, 4)):
            kind = rng.choice(["word", "word", "optional", "gap", "any_of"])
            if kind == "word" or depth > 1:
                made.append(rng.choice("abc"))
            elif kind == "optional":
                made.append(f"<<beginOptional>> {items(depth + 1)} <<endOptional>>")
            elif kind == "gap":
                a = rng.randint(0, 2)
                made.append(f"<<var;match=.{{{a},{a + rng.randint(0, 2)}}}>>")
            else:
                made.append(f"<<var;match={rng.choice(['a|b b', 'c|a b|b'])}>>")
        return " ".join(made)

    for _ in range(150):
        parsed = licenses.parse(f"{items(0)} a b {items(0)}")
        machine = licenses.Automaton("x", 1.0, parsed)
        pattern = re.compile(" " + licenses._pattern(parsed))
        for _ in range(40):
            words = [rng.choice([b"a", b"b", b"c"]) for _ in range(rng.randint(0, 14))]
            joined = b" " + b" ".join(words) + b" "
            assert machine.accepts(words, joined) == bool(pattern.search(joined.decode())), (parsed, words)


def sample(items, rng, full):
    """A text that a template accepts."""
    out = []
    for item in items:
        if item[0] == "word":
            out.append(item[1].decode())
        elif item[0] == "optional":
            out += sample(item[1], rng, full) if full else []
        elif item[0] == "gap":
            out += [f"w{rng.randint(0, 9)}" for _ in range(item[2] if full else item[1])]
        else:
            out += sample(rng.choice(item[1]), rng, full)
    return out


def test_all_templates_accept_their_wording_and_no_other():
    rng = random.Random(1)
    for machine in licenses.automata():
        for full in (True, False):
            words = sample(machine.items, rng, full)
            text = "before " + ", ".join(w.title() for w in words) + ". after"
            n, _, _, _, _, labels, score = licenses.scan_text(text.encode())
            assert n == len(words) + 2 and machine.label in labels.split(",") and score >= machine.weight
            at = words.index(machine.anchor.split()[0].decode())
            assert machine.label not in licenses.scan_text(" ".join([*words[:at], "other", *words[at + 1 :]]).encode())[5].split(",") or machine.weight < 1


def test_license_cases(spark):
    docs = [(1, None), (2, ""), (3, "MIT-License, the Apache\nLicense; CC BY 4.0"), (4, "Released under the MIT License."), (4, "Released under the MIT License."), (None, "mit licenses"), (5, "é mit LICENSE ä"), (6, "w " * 200_000 + "gnu general public license " * 3)]
    df = spark.createDataFrame(docs, "doc_id long, text string").selectExpr("*", "1 AS labels", "2 AS n_words")
    got = sorted((tuple(r) for r in licenses.scan(df).collect()), key=str)
    want = [
        (1, 0, 0, None, None, "", "", 0.0),
        (2, 0, 0, None, None, "", "", 0.0),
        (3, 9, 3, 0, 5, "apache,cc-by,mit", "apache,cc-by,mit", 0.5),
        (4, 5, 1, 3, 3, "mit", "mit", 0.9),
        (4, 5, 1, 3, 3, "mit", "mit", 0.9),
        (None, 2, 0, None, None, "", "", 0.0),
        (5, 4, 1, 1, 1, "mit", "mit", 0.5),
        (6, 200_012, 3, 200_000, 200_008, "gpl", "gpl", 0.5),
    ]
    assert got == sorted(want, key=str)
    assert licenses.scan(df.limit(0)).count() == 0


def runs_by_words(words):
    """Every maximal run from the definition: smallest period of each stretch, no neighbour extends it."""
    found = []
    n = len(words)
    for q in range(1, n // 3 + 1):
        i = 0
        while i + q < n:
            j = i
            while j + q < n and words[j] == words[j + q]:
                j += 1
            a, z = i, j + q
            if z - a >= max(24, 3 * q):
                part = words[a:z]
                if not any(all(part[k] == part[k + p] for k in range(len(part) - p)) for p in range(1, q)):
                    found.append((a, z - a, q))
            i = j + 1
    return sorted(found, key=lambda r: (r[0], r[2]))


def texts_with_runs(rng, n):
    out = []
    for _ in range(n):
        words = []
        for _ in range(rng.randint(0, 6)):
            if rng.random() < 0.5:
                words += [rng.choice("abcdefgh") for _ in range(rng.randint(0, 30))]
            else:
                unit = [rng.choice("ab") for _ in range(rng.randint(1, 14))]
                words += unit * rng.randint(1, 12) + unit[: rng.randint(0, len(unit))]
        out.append([w.encode() for w in words])
    return out


@pytest.mark.parametrize("pairs", [7, 1000, 1 << 20])
def test_runs_equal_the_definition(monkeypatch, pairs):
    monkeypatch.setattr(periodic_runs, "PAIRS", pairs)
    texts = texts_with_runs(random.Random(pairs), 120)
    texts += [[], [b"a"] * 23, [b"a"] * 24, [b"a"] * 400, [b"a", b"b"] * 12, [b"a", b"b", b"c"] * 7, [b"x"] * 30 + [b"y"] * 30]
    assert periodic_runs.find_runs(texts) == [runs_by_words(w) for w in texts]


def test_runs_survive_hash_collisions(monkeypatch):
    """Hashes that are always equal, or equal for Thue-Morse words: extensions are measured by words."""
    morse = [b"ab"[bin(k).count("1") % 2 :][:1] for k in range(1 << 13)]
    texts = [morse, [b"a"] * 50 + morse[:4096] + [b"b", b"c"] * 20]
    assert periodic_runs.find_runs(texts) == [periodic_runs_plain(w) for w in texts]
    monkeypatch.setattr(periodic_runs._Hashes, "equal", lambda self, at, size, shift: np.ones(len(at), dtype=bool))
    some = texts_with_runs(random.Random(5), 40)
    assert periodic_runs.find_runs(some) == [runs_by_words(w) for w in some]


def periodic_runs_plain(words):
    ids = np.array([w[0] for w in words])
    least = {}
    for p in range(1, len(words) // 3 + 1):
        other = np.concatenate([[-1], np.flatnonzero(ids[:-p] != ids[p:]), [len(words) - p]])
        for k in np.flatnonzero(np.diff(other) - 1 + p >= max(24, 3 * p)):
            least.setdefault((int(other[k]) + 1, int(other[k + 1]) + p), p)
    return sorted(((a, z - a, p) for (a, z), p in least.items()), key=lambda r: (r[0], r[2]))


def test_planted_tail():
    for doc_id in range(300):
        words = [str(k) for k in range(doc_id % 90)]
        h = zlib.crc32(str(doc_id).encode())
        g, n = h // 10, len(words)
        want = list(words)
        if h % 10 == 0 and n:
            a = g % n
            p = 1 + math.floor((n - a) / (3 + g % 8))
            want = [words[a + (i - a) % p] if i >= a else words[i] for i in range(n)]
        assert periodic_runs.planted(doc_id, words) == want


def test_periodic_run_rows(spark):
    digest = lambda s: hashlib.sha256(s.encode()).hexdigest()
    texts = [(1, None), (2, " \n"), (3, "a b " * 12), (3, "a b " * 12), (None, "x" + " c" * 30 + " y" + " d e f" * 10), (7, " ".join("zz" for _ in range(40))), (8, "q " * 300_000)]
    df = spark.createDataFrame(texts, "doc_id long, text string").selectExpr("*", "1 AS start", "2 AS n_runs")
    got = sorted((tuple(r) for r in periodic_runs.periodic_runs(df, plant=False).collect()), key=str)
    none = (0, None, None, None, None, digest(""))
    want = [
        (1, *none, digest("")),
        (2, *none, digest("")),
        (3, 1, 0, 24, 2, 12000, digest("0,24,2\n"), digest("a b")),
        (3, 1, 0, 24, 2, 12000, digest("0,24,2\n"), digest("a b")),
        (None, 2, 1, 30, 1, 30000, digest("1,30,1\n32,30,3\n"), digest("x c y d e f")),
        (7, *none, digest(" ".join("zz" for _ in range(40)))),
        (8, 1, 0, 300_000, 1, 300_000_000, digest("0,300000,1\n"), digest("q")),
    ]
    assert got == sorted(want, key=str)
    assert periodic_runs.periodic_runs(df.limit(0)).count() == 0
