"""Passages, lines, benchmark items and personal data against plain Python."""

import hashlib
import random
import re

import numpy as np
import pytest

from rareflow.llm import decontaminate, lines, personal, suffixes
from rareflow.llm.decontaminate import Decontamination
from rareflow.llm.lines import LineDedup, common_blocks, patience
from rareflow.llm.personal import PersonalData
from rareflow.llm.suffixes import RepeatedPassages

SCHEMA = "doc_id long, text string"


# -- repeated passages --------------------------------------------------------


def repeated(rows, length):
    """Spans covered by windows of ``length`` words that occur twice."""
    texts = [(i, (t or "").encode().lower().split()) for i, t in dict.fromkeys(rows) if i is not None]
    where = {}
    for i, words in texts:
        for p in range(len(words) - length + 1):
            where.setdefault(b" ".join(words[p:p + length]), []).append(i)
    out = []
    for i, words in texts:
        spans = []
        for p in range(len(words) - length + 1):
            ids = where[b" ".join(words[p:p + length])]
            if len(ids) < 2:
                continue
            if spans and p <= spans[-1][1]:
                spans[-1][1], spans[-1][2] = p + length, min(spans[-1][2], *ids)
            else:
                spans.append([p, p + length, min(ids)])
        out += [(i, *s) for s in spans]
    return sorted(out)


def test_passages_equal_all_windows(spark):
    rng = random.Random(4)
    word = lambda: f"w{rng.randrange(500)}"
    shared = [[word() for _ in range(n)] for n in (20, 24, 25, 26, 40, 90)]
    rows = []
    for i in range(60):
        text = [word() for _ in range(rng.randrange(60))]
        for _ in range(rng.randrange(3)):
            text += rng.choice(shared)[rng.randrange(3):] + [word() for _ in range(rng.randrange(30))]
        rows.append((i, " ".join(text)))
    rows += [(60, rows[3][1]), (61, rows[3][1]), (62, None), (63, ""), (None, rows[3][1]),
             (3, rows[3][1]), (64, "the " * 3000), (65, "the " * 200)]
    settings = RepeatedPassages(length=25, gram=4, window=9)
    got = settings.spans(spark.createDataFrame(rows, SCHEMA).repartition(5))
    assert sorted(map(tuple, got.collect())) == repeated(rows, 25)


def test_no_passages(spark):
    assert RepeatedPassages().spans(spark.createDataFrame([], SCHEMA)).collect() == []


def test_minimisers_are_the_smallest_of_each_run():
    words = np.random.default_rng(1).integers(0, 2 ** 63, 500).astype(np.uint64)
    with np.errstate(over="ignore"):
        values = suffixes.windows(words, 8) & ~suffixes.PLACE
        got = suffixes.minimisers(words, 8, 17)
    want = {p + int(np.argmin(values[p:p + 17])) for p in range(len(values) - 16)}
    assert set(got.tolist()) == want


def test_neighbours_over_batches_and_edges():
    import pyarrow as pa
    rows = [(1, 1), (1, 2), (2, 3), (3, 4), (3, 5), (3, 5), (4, 6), (5, 7)]
    batches = [suffixes.keyed([(np.array([k], np.uint64), i, 0, np.array([0]))]) for k, i in rows]
    got = pa.Table.from_batches(suffixes._neighbours(iter(batches))).to_pylist()
    assert [(r["key"], r["id"], r["edge"], r["least"]) for r in got] == [
        (1, 1, True, 1), (1, 2, True, 1), (3, 4, False, 4), (3, 5, False, 4), (5, 7, True, 7)]


# -- lines --------------------------------------------------------------------


def test_patience_matches_in_order():
    one, two = list("abcdxefg"), list("zbcdyefa")
    pairs = patience([ord(c) for c in one], [ord(c) for c in two])
    assert [(one[i], two[j]) for i, j in pairs] == [(c, c) for c in "bcdef"]
    assert patience([], [1]) == [] and patience([1, 1], [1, 1]) == [(0, 0), (1, 1)]
    assert common_blocks([1, 2, 3, 9], [8, 1, 2, 3], [9, 3, 3, 3], 9) == [1, 2, 3]
    assert common_blocks([1, 2, 3, 9], [8, 1, 2, 3], [9, 3, 3, 3], 10) == []


def without_common_lines(rows, least, rare):
    """The operator's rule over all pairs it names, by plain loops."""
    texts = {}
    for i, t in sorted((r for r in rows if r[0] is not None and (r[1] or "").strip(" ")), key=lambda r: r[0]):
        texts.setdefault(i, t)
    hashed = {i: [x.strip(" ") for x in t.split("\n")] for i, t in texts.items()}
    first, holders = {}, {}
    for i, t in texts.items():
        first.setdefault(t, i)
    for i in first.values():
        for x in set(hashed[i]) - {""}:
            holders.setdefault(x, []).append(i)
    pairs = set()
    for ids in holders.values():
        pairs |= {(ids[0], b) for b in ids[1:]}
        if len(ids) <= rare:
            pairs |= {(a, b) for a in ids for b in ids if a < b}
    code = {x: k + 1 for k, x in enumerate(sorted(holders))} | {"": 0}
    gone = {i: set() for i in texts}
    for a, b in pairs:
        gone[b] |= set(common_blocks([code[x] for x in hashed[a]], [code[x] for x in hashed[b]],
                                     [len(x) for x in hashed[b]], least))
    for i, t in texts.items():
        if first[t] != i and sum(map(len, hashed[i])) >= least:
            gone[i] = set(range(len(hashed[i])))
    return gone


def test_lines_equal_the_rule(spark):
    rng = random.Random(9)
    pool = [f"line number {k} " + "x" * rng.randrange(30) for k in range(60)] + ["", "ok"]
    rows = []
    for i in range(80):
        start = rng.randrange(50)
        text = pool[start:start + rng.randrange(1, 8)] + [f"own {i}"] + rng.sample(pool, rng.randrange(4))
        rows.append((i, "\n".join(["very common line that many documents share, again"] * (i % 3 == 0) + text)))
    rows += [(80, rows[5][1]), (81, rows[5][1]), (82, None), (83, ""), (84, " \n "), (None, rows[5][1]),
             (85, "ok"), (86, "ok"), (7, rows[7][1])]
    docs = spark.createDataFrame(rows, SCHEMA)
    want = without_common_lines(rows, 50, 6)
    got = LineDedup().clean(docs).collect()
    assert len(got) == len(rows)
    for r in got:
        text = dict(rows)[r["doc_id"]] if r["doc_id"] is not None else rows[5][1]
        parts = (text or "").split("\n")
        left = [x for k, x in enumerate(parts) if k not in want.get(r["doc_id"], ())]
        assert r["text"] == (None if text is None else "\n".join(left)), r
        assert r["n_removed"] == len(parts) - len(left) and (r["n_lines"] > 0) == bool(text)
    kept = lines.dedup_lines(docs.selectExpr("*", "length(text) n_chars", "'s' decided"))
    assert kept.columns == [*docs.columns, "n_chars", "decided"]
    ids = {r["doc_id"] for r in kept.collect()}
    assert {None, 82, 83, 84, 85, 86} <= ids and not {80, 81} & ids


def test_whole_lines_equal_all_pairs(spark):
    """Frequent lines whose first holder lacks the block, holds it twice or in another order."""
    rng = random.Random(4)
    short = [f"short line {k} of a block" for k in range(4)]
    long = "a line of its own that has more than fifty characters in it"
    other = "another line of its own that has more than fifty characters"
    rows = [(k, f"only {k}\n{short[k]}\nown {k}") for k in range(4)]
    rows += [(i, "\n".join([f"head {i}", *short, f"tail {i}"])) for i in range(4, 14)]
    rows += [(20, f"x\n{long}\ny\n{long}\nz"), (21, f"{other}\nq\n{long}")]
    rows += [(i, f"first {i}\n{long}\nthen {i}" + f"\n{other}" * (i % 3)) for i in range(22, 40)]
    pool = [f"line number {k} " + "x" * rng.randrange(30) for k in range(40)] + ["", "ok", long, other]
    for i in range(40, 160):
        start = rng.randrange(34)
        rows.append((i, "\n".join(pool[start:start + rng.randrange(1, 8)] + [f"own {i}"]
                                  + [rng.choice(pool) for _ in range(rng.randrange(9))])))
    docs = spark.createDataFrame(rows, SCHEMA)
    want = without_common_lines(rows, 50, len(rows))
    assert want != without_common_lines(rows, 50, 6)
    for r in LineDedup(whole=True).clean(docs).collect():
        left = [x for k, x in enumerate(dict(rows)[r["doc_id"]].split("\n")) if k not in want[r["doc_id"]]]
        assert r["text"] == "\n".join(left), r


def test_shortest_runs_cover_blocks():
    rng = np.random.default_rng(2)
    for _ in range(50):
        sizes = rng.integers(0, 30, rng.integers(1, 30))
        text = np.where(sizes == 0, 0, rng.integers(1, 9, len(sizes)))
        key, low, high, times = lines.shortest_runs(text, sizes, 50)
        assert times.sum() == len(key) and (times > 0).sum() == len(set(key.tolist()))
        assert len(set(key.tolist())) == len({tuple(text[a:b]) for a, b in zip(low, high)})
        for a in range(len(text)):
            for b in range(a + 1, len(text) + 1):
                if sizes[a:b].sum() >= 50:
                    inside = (low >= a) & (high <= b)
                    assert {*range(a, b)} == {j for x, y in zip(low[inside], high[inside])
                                              for j in range(x, y)}


def test_no_lines_whole(spark):
    assert LineDedup(whole=True).clean(spark.createDataFrame([], SCHEMA)).collect() == []


def test_no_lines(spark):
    assert LineDedup().clean(spark.createDataFrame([], SCHEMA)).collect() == []


# -- benchmark items ----------------------------------------------------------


def edits_within(item, text):
    """Least edit distance of ``item`` to any region of ``text``, by the full table."""
    row = np.zeros(len(text) + 1, int)
    for i, c in enumerate(item):
        new = np.empty_like(row)
        new[0] = i + 1
        for j, d in enumerate(text):
            new[j + 1] = min(row[j] + (c != d), row[j + 1] + 1, new[j] + 1)
        row = new
    return int(row.min())


def plain(text):
    return re.sub(r"[^a-z0-9\x80-\U0010ffff]+", " ", re.sub("[A-Z]", lambda m: m[0].lower(), text)).strip()


def test_items_equal_full_alignment(spark):
    rng = random.Random(2)
    word = lambda: "".join(rng.choice("abcdeé") for _ in range(rng.randint(2, 7)))
    items = [(i, " ".join(word() for _ in range(rng.randint(8, 16)))) for i in range(12)]
    rows = []
    for i in range(40):
        text = " ".join(word() for _ in range(25))
        if i % 2:
            piece = list(rng.choice(items)[1])
            for _ in range(rng.randrange(6)):
                spot = rng.randrange(len(piece))
                piece[spot:spot + rng.randint(0, 1)] = rng.choice(["", "q", " ", "ZZ"])
            text = text[:60] + ", " + "".join(piece).upper().replace("É", "é") + "! " + text[60:]
        rows.append((i, text))
    found = Decontamination().mark(spark.createDataFrame(rows, SCHEMA),
                                   spark.createDataFrame(items, "item_id long, text string"))
    got = {(r["doc_id"], h["item_id"]): h for r in found.collect() for h in r["hits"]}
    want = {}
    for i, text in rows:
        for k, item in items:
            m = len(plain(item))
            edits = edits_within(plain(item), plain(text))
            if edits <= min(int(m * 0.05), (m - 12) // 12):
                want[i, k] = edits
    assert {key: h["edits"] for key, h in got.items()} == want and len(want) > 10
    for (i, k), h in got.items():
        region = plain(rows[i][1][h["start"]:h["end"]])
        assert edits_within(plain(items[k][1]), region) == h["edits"]


def test_odd_items_and_texts(spark):
    item = "The quick brown fox jumps over the lazy dog and runs away from the farmer"
    items = spark.createDataFrame([(1, item), (2, item), (None, item), (3, None), (4, "short"), (5, "")],
                                  "item_id long, text string")
    long = "lorem ipsum dolor " * 20_000
    rows = [(1, long + item.upper() + long), (2, None), (3, ""), (None, item), (4, item[:40]),
            (5, item.replace(" ", "\n--\n")), (6, item[30:]), (7, item[1:]), (8, item[:-1])]
    docs = spark.createDataFrame(rows, SCHEMA).selectExpr("*", "1 hits", "'x' item_id")
    for chunk in (10, 10 ** 6):
        got = Decontamination(chunk_chars=chunk).mark(docs, items).collect()
        assert [[h["item_id"] for h in r["hits"]] for r in got] == [
            [1, 2], [], [], [1, 2], [], [1, 2], [], [1, 2], [1, 2]]
    assert got[0]["hits"][0]["start"] == len(long) and got[0]["hits"][0]["end"] == len(long) + len(item)
    clean = decontaminate.without_benchmark(docs, items)
    assert clean.columns == docs.columns and [r["doc_id"] for r in clean.collect()] == [2, 3, 4, 6]
    none = Decontamination().mark(docs, items.limit(0)).collect()
    assert all(r["hits"] == [] for r in none) and len(none) == 9


# -- personal data ------------------------------------------------------------

BASE = {"email": r"[A-Za-z0-9._%+-]+@[A-Za-z0-9-]+(\.[A-Za-z0-9-]+)+",
        "ip": r"[0-9]+(\.[0-9]+)(\.[0-9]+)(\.[0-9]+)", "card": r"[0-9]([\x20-]?[0-9])+",
        "phone": r"\+[0-9][\x20().0-9-]+[0-9]"}


def base_spans(text):
    out = []
    for kind, pattern in BASE.items():
        for m in re.finditer(pattern, text):
            digits = re.sub("[^0-9]", "", m[0])
            if (kind == "ip" and any(int(p) > 255 for p in m[0].split("."))
                    or kind == "card" and not (16 <= len(digits) <= 19 and personal.luhn(digits))
                    or kind == "phone" and not 8 <= len(digits) <= 15):
                continue
            out.append((kind, *m.span()))
    return out


def test_fixed_patterns_equal_plain_search():
    rng = random.Random(6)
    bits = ["a", "b.c", "@", ".", "1", "23", "255", "4111111111111111", "+1 ", "(", ")", "-", " ", "%", "é",
            "x@y.z", "10.0.0.1", "+49 30 1234567", "\n", "_"]
    for _ in range(4000):
        text = "".join(rng.choice(bits) for _ in range(rng.randrange(14)))
        assert personal.fixed_spans(text) == base_spans(text), text
    long = "a" * 200_000
    assert personal.fixed_spans(long + "@" + long) == []
    assert personal.fixed_spans("1" * 200_000 + ".2.3.4") == []


def test_personal_data(spark):
    rows = [(i, f"login password=Secr3t{i:06d}x9 done") for i in range(30)] + [
        (30, "mail me: é a.b@c.org, or call +49 30 1234567"), (31, None), (32, ""),
        (33, "4111 1111 1111 1111 and 10.0.0.1"), (33, "4111 1111 1111 1111 and 10.0.0.1"),
        (None, "x@y.zz"), (34, "note: something12345")]
    got = PersonalData().mark(spark.createDataFrame(rows, SCHEMA)
                              .selectExpr("*", "'old' spans")).collect()
    assert len(got) == len(rows)
    for r in got:
        base = base_spans(r["text"] or "")
        told = ",".join(f"{k}:{s}:{e}" for k, s, e in base)
        assert r["base_sha256"] == hashlib.sha256(told.encode()).hexdigest()
        assert all(r[f"n_{k}"] == sum(x == k for x, _, _ in base) for k in BASE)
        assert not told or told in r["spans"]
    assert got[0]["spans"] == "secret:15:29" and got[-1]["spans"] == ""
    assert PersonalData().mark(spark.createDataFrame([], SCHEMA)).collect() == []


def test_logins_in_urls_are_marked(spark):
    """The password and a dotted host look like an email; the login is a span all the same."""
    rows = [(i, f"see postgres://admin:Secr3t99@db{i}.example.com/x for more") for i in range(8)]
    spans = {((k, s, e), f) for (k, s, e), f in personal.candidates(rows[0][1])}
    assert {(("url_login", 15, 29), False), (("email", 21, 45), True)} <= spans
    for r in PersonalData().mark(spark.createDataFrame(rows, SCHEMA)).collect():
        assert "email:21:45" in r["spans"] and "url_login:15:29" in r["spans"]
    # a loose span that touches a fixed one of its kind still goes
    assert [k for (k, _, _), _ in personal.candidates("call +49 0123 456 7890")] == ["phone"]


def test_reliabilities_are_found():
    """A labeler that votes at random gets rates near one half, a sound one far apart."""
    rng = random.Random(1)
    counts = {}
    for _ in range(4000):
        true = rng.random() < 0.4
        right = lambda p: int((rng.random() < p) == true)
        votes = (0, 1, right(0.9), right(0.85))
        pattern = ("secret", *votes, int(true if rng.random() < 0.8 else not true), 1, 1, 0, 1)
        counts[pattern] = counts.get(pattern, 0) + 1
    model = PersonalData().fit(sorted(counts.items()))
    rate = model.reliability["secret"]
    assert rate[1, 2] - rate[0, 2] > 0.4 and rate[1, 3] - rate[0, 3] > 0.4
    high = model.score(("secret", 0, 1, 1, 1, 1, 1, 1, 0, 1))
    assert high > 0.5 > model.score(("secret", 0, 1, 0, 0, 0, 1, 1, 0, 1))


@pytest.mark.parametrize("size", [8, 127, 128, 129, 140, 5000])
def test_secrets_of_any_length(size):
    value = ("Ab3" * size)[:size]
    for name in ("password", "p" * 30, "api_secret_token_of_production"):
        text = f"x {name}={value} y"
        assert ("secret", 3 + len(name), 3 + len(name) + size) in personal.loose_spans(text)
        listed = personal.described(text, "secret", 3 + len(name), 3 + len(name) + size, False)[3]
        assert listed == (name != "p" * 30)


@pytest.mark.parametrize("size", [1, 64, 65, 80, 3000])
def test_logins_and_hidden_addresses_of_any_length(size):
    text = f"postgres://{'u' * size}:{'p' * size}@db.example.com/x"
    assert ("url_login", 11, 12 + 2 * size) in personal.loose_spans(text)
    hidden = f"{'n' * size} [at] {'d' * size}" + " [dot] sub" * 7 + " dot"
    assert ("email", 0, len(hidden) - 4) in personal.loose_spans(hidden)


def test_long_runs_take_linear_time():
    import time

    for unit in ("a", "a_", "ab://", "a:b", "user:pass", "x [at] y", "password=", "n.n"):
        text = unit * (400_000 // len(unit))
        begin = time.perf_counter()
        personal.loose_spans(text)
        assert time.perf_counter() - begin < 5, unit


def test_long_items_are_cut_evenly():
    from rareflow.llm.decontaminate import WIDEST, ItemIndex

    rng = random.Random(3)
    letters = "".join(rng.choice("abcdefghijklmnopqrstuvwxyz") for _ in range(WIDEST + 13))
    index = ItemIndex([(1, letters)], 12, 0.05)
    assert [len(part) for _, part in index.items] == [2007, 2006]
    assert index.search(letters[-13:] + " and other words") == []
    assert [h["item_id"] for h in index.search("before " + letters)] == [1]
