import random
import re
import zlib
from collections import Counter

import pytest
from pyspark.sql import functions as F

from sigloom.llm import spelling


def plain_words(rows, every=31):
    """Every run, one after another."""
    counts = Counter()
    for i, text in rows:
        for run in re.findall("[A-Za-zÀ-ÿ]+", text or ""):
            run = "".join(chr(ord(c) + 32) if "A" <= c <= "Z" else c for c in run)
            h = zlib.crc32(f"{'' if i is None else i}:{run}".encode())
            counts[run[: h % len(run)] + run[h % len(run) + 1 :] if h % every == 0 else run] += 1
    return {w: n for w, n in counts.items() if len(w) >= 7 and n >= 2}


def one_edit(a, b):
    if abs(len(a) - len(b)) > 1 or a == b:
        return False
    k = 0
    while k < min(len(a), len(b)) and a[k] == b[k]:
        k += 1
    return a[k + (len(a) >= len(b)) :] == b[k + (len(b) >= len(a)) :]


def brute(rows, every=31):
    """All pairs of words."""
    n = plain_words(rows, every)
    near = {w: [x for x in n if one_edit(w, x)] for w in n}
    form = {}
    for w, found in near.items():
        best = min(found, key=lambda x: (-n[x], x), default=None)
        form[w] = best if best and n[best] >= 10 * n[w] else None
    out = []
    for w in n:
        root = w
        while form[root]:
            root = form[root]
        out.append((w, form[w], root, n[w], len(near[w]), n[form[w]] if form[w] else None))
    return sorted(out)


def made(seed, n=60):
    """Words of few letters, many a letter apart at either end, with runs of equal letters, frequencies of all sizes, and very long words."""
    r = random.Random(seed)
    stems = ["".join(r.choice("abé") for _ in range(r.randint(6, 11))) for _ in range(8)] + ["a" * k for k in (7, 8, 9, 40)] + ["a" * 2000, "a" * 1999 + "b", "ÿ×÷Éaaaa", "AAAAAAB"]

    def edited(w):
        k = r.randrange(len(w) + 1)
        return r.choice([w, w, w, w[:k] + w[k + 1 :], w[:k] + r.choice("abé") + w[k:], w[:k] + r.choice("abé") + w[k + 1 :]])

    return [(r.choice([k, k, None]), r.choice([" ", ". ", "_9", "\n"]).join(edited(stems[min(int(r.expovariate(0.4)), len(stems) - 1)]) for _ in range(r.randint(0, 60)))) for k in range(n)]


@pytest.mark.parametrize("seed", [0, 1])
def test_equals_all_pairs(spark, seed):
    rows = made(seed)
    found = spelling.spelling_groups(spark.createDataFrame(rows, "doc_id long, text string").repartition(3)).collect()
    assert sorted(map(tuple, found)) == brute(rows)
    assert any(r["form"] for r in found) and any(r["n_near"] > 5 for r in found)


def test_forms_are_followed_to_the_last(spark):
    rows = [(k, "abcdefg " * 1000 + "abcdefgh " * 100 + "abcdefghi " * 10) for k in range(2)]
    every = 2**40
    found = {r["word"]: (r["form"], r["root"], r["n"], r["n_near"], r["form_n"]) for r in spelling.spelling_groups(spark.createDataFrame(rows, "doc_id long, text string"), every=every).collect()}
    assert found == {"abcdefg": (None, "abcdefg", 2000, 1, None), "abcdefgh": ("abcdefg", "abcdefg", 200, 2, 2000), "abcdefghi": ("abcdefgh", "abcdefg", 20, 1, 200)}


def test_odd_rows(spark, odd, nothing, clashing):
    rows = [(r["doc_id"], r["text"]) for r in odd.collect()]
    assert sorted(map(tuple, spelling.spelling_groups(odd).collect())) == brute(rows)
    names = clashing.withColumns({n: F.lit(1) for n in ("word", "form", "root", "n", "run", "s")})
    assert sorted(map(tuple, spelling.spelling_groups(names).collect())) == brute(rows)
    found = spelling.spelling_groups(nothing)
    assert found.columns == ["word", "form", "root", "n", "n_near", "form_n"] and found.count() == 0


def test_words_are_worked_out_once_and_pairs_are_not_written(spark, monkeypatch):
    """The work grew with repeated expressions and with rounds of staged states; now words, links' sums and roots are staged."""
    rows = [(k, " ".join("abcdef" + chr(97 + j) * 2 for j in range(26)) + " ÀBCDEFgh Àbcdefgi") for k in range(2)]
    df = spark.createDataFrame(rows, "doc_id long, text string")
    plan = spelling.noisy_words(df, "doc_id", "text", 7, 31)._jdf.queryExecution().optimizedPlan().toString()
    assert plan.count("crc32(") <= 2 and plan.count("translate(") <= 2
    staged, stage = [], spelling.stage
    monkeypatch.setattr(spelling, "stage", lambda table, label: staged.append(label) or stage(table, label))
    assert sorted(map(tuple, spelling.spelling_groups(df).collect())) == brute(rows)
    assert set(staged) == {"words", "forms", "roots"}


def test_links_are_counted_where_words_meet(spark):
    words = [("abcdef" + chr(97 + j), 100 - j) for j in range(26)] + [("abcdefaa", 7), ("abcdefba", 9)]
    links = spelling.cut_links(spark.createDataFrame(words, "word string, n long")).collect()
    # A row for what is left of a word with others, not one for each of 26 * 25 pairs.
    assert len(links) < 4 * len(words)
    assert sum(r["near"] for r in links) == sum(one_edit(a, b) for a, _ in words for b, _ in words)


def test_long_words_meet_those_of_the_limit(spark):
    r, rows, n = random.Random(7), [], spelling.LONG
    for size in (n - 2, n - 1, n, n + 1, n + 2):
        word = "".join(r.choice("ab") for _ in range(size))
        for k, times in ((0, 1000), (r.randrange(size), 60), (size - 1, 3)):
            rows += [(times, f"{word} " * times), (times, f"{word[:k]}{word[k + 1 :]} " * 4 + f"{word[:k]}c{word[k:]} " * (times // 10 + 2) + f"{word[:k]}é{word[k + 1 :]} " * 2)]
    found = sorted(map(tuple, spelling.spelling_groups(spark.createDataFrame(rows, "doc_id long, text string").repartition(3)).collect()))
    assert found == brute(rows)
    sizes = {(len(w), len(f)) for w, f, *_ in found if f}
    assert {(n, n + 1), (n + 1, n), (n, n), (n + 1, n + 1)} <= sizes
