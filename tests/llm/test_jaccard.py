import random
import re
from collections import Counter, defaultdict

import pytest

from plumbline.llm import jaccard

ROWS = "doc_id long, text string"


def brute_force(rows):
    """{doc_id: (shingles, component)} by counting every shared shingle of every pair."""
    sets = {}
    for doc_id, text in rows:
        words = re.findall(r"[^\x20\x09-\x0D]+", "".join(chr(ord(c) + 32) if "A" <= c <= "Z" else c for c in text or ""))
        sets[doc_id] = {tuple(words[k : k + 5]) for k in range(len(words) - 4)} or ({tuple(words)} if words else set())
    holders, shared = defaultdict(list), Counter()
    for doc_id, s in sorted(sets.items()):
        for g in s:
            shared.update((other, doc_id) for other in holders[g])
            holders[g].append(doc_id)
    group = {d: d for d in sets}

    def root(d):
        while group[d] != d:
            d = group[d]
        return d

    for (a, b), n in shared.items():
        if 100 * n >= 80 * (len(sets[a]) + len(sets[b]) - n):
            a, b = sorted((root(a), root(b)))
            group[b] = a
    return {d: (len(s), root(d)) for d, s in sets.items()}


def result(spark, rows):
    found = jaccard.linked_groups(spark.createDataFrame(rows, ROWS)).collect()
    assert len(found) == len(rows)
    return {r.doc_id: (r.n_shingles, r.component_id) for r in found}


def family(r, base, edits):
    words = list(base)
    for _ in range(edits):
        words[r.randrange(len(words))] = f"w{r.randrange(10**6)}"
    return " ".join(words)


@pytest.mark.parametrize("unit", [4, 256])
def test_families_of_edited_copies(spark, monkeypatch, unit):
    monkeypatch.setattr(jaccard, "UNIT_SETS", unit)
    r = random.Random(unit)
    rows = []
    for size in (60, 25, 3):
        base = [f"w{r.randrange(4000)}" for _ in range(r.randrange(60, 160))]
        rows += [(len(rows) + k, family(r, base, r.randrange(0, 6))) for k in range(size)]
    passage = " ".join(f"p{k}" for k in range(40))
    rows += [(len(rows) + k, " ".join(f"w{r.randrange(10**6)}" for _ in range(r.randrange(5, 90))) + f" {passage}") for k in range(40)]
    assert result(spark, rows) == brute_force(rows)


def test_threshold_is_inclusive(spark):
    words = [f"a{k}" for k in range(40)]
    rows = [(1, " ".join(words[:13])), (2, " ".join(words[:12])), (3, " ".join(words[:20])), (4, " ".join(words[:15]))]
    assert result(spark, rows) == brute_force(rows)


def test_odd_rows(spark):
    rows = [(1, None), (2, ""), (3, " \t\n"), (4, "One two"), (5, "one  TWO"), (6, "one"), (7, "a b c d e"), (8, "A B C D E"), (9, "É b c d e"), (10, "é b c d e"), (11, "w " * 30000), (12, "w w w w w")]
    assert result(spark, rows) == brute_force(rows)


def test_repeated_rows_and_clashing_columns(spark):
    docs = spark.createDataFrame([(1, "a b c d e f", "x"), (1, "a b c d e f", "x"), (2, "a b c d e f", "y"), (None, "a b c d e f", "z")], "doc_id long, text string, component_id string")
    assert sorted((r.doc_id or 0, r.component_id) for r in jaccard.linked_groups(docs).collect()) == [(0, 1), (1, 1), (1, 1), (2, 1)]
    kept = jaccard.keep_one(docs)
    assert kept.columns == docs.columns
    assert [r.component_id for r in kept.collect()] == ["x"]


def test_one_id_of_different_texts(spark):
    rows = [(1, "a b c d e f"), (1, "g h i j k l"), (2, "a b c d e f"), (3, "g h i j k l"), (None, "g h i j k l"), (None, "m n o p q r"), (None, "m n o p q r"), (None, ""), (None, None), (4, "s")]
    kept = jaccard.keep_one(spark.createDataFrame(rows, ROWS)).collect()
    assert sorted((r.doc_id or 0, r.text or "") for r in kept) == [(0, ""), (0, ""), (0, "m n o p q r"), (1, "a b c d e f"), (1, "g h i j k l"), (4, "s")]


def test_words_that_a_polynomial_cannot_tell(spark):
    ab = "".join("ab"[bin(k).count("1") % 2] for k in range(1024))
    rows = [(1, ab), (2, ab.translate(str.maketrans("ab", "ba"))), (3, "a\x00"), (4, "a"), (5, ab)]
    assert result(spark, rows) == brute_force(rows)


def test_shingles_of_one_first_hash(monkeypatch):
    real = jaccard.gram_hashes
    monkeypatch.setattr(jaccard, "gram_hashes", lambda halves, n, which=0: real(halves, n, which) if which else real(halves, n, which) % 5)
    a, b = jaccard.shingle_sets(["a b c d e", "f g h i j"])
    assert jaccard._signature(a) != jaccard._signature(b)
    pair = [jaccard.np.stack([[7, 9], k]).astype(jaccard.np.uint64) for k in ([1, 2], [1, 3])]
    assert len(set(jaccard.np.concatenate(jaccard._numbered(pair)).tolist())) == 3


def test_empty_table(spark):
    docs = spark.createDataFrame([], ROWS)
    assert jaccard.linked_groups(docs).collect() == [] and jaccard.keep_one(docs).collect() == []


def test_shuffle_files_are_swept_after_the_counts_and_after_the_sets(spark, monkeypatch):
    done = []
    for name in ("swept", "checkpointed", "deleted", "link_sets"):
        monkeypatch.setattr(jaccard, name, lambda *a, name=name, real=getattr(jaccard, name): (done.append(name), real(*a))[1])
    docs = spark.createDataFrame([(1, "a b c d e f"), (2, "g h i j k l"), (3, "a b c d e f")], ROWS)
    assert jaccard.keep_one(docs).count() == 2
    assert done[:6] == ["swept", "checkpointed", "checkpointed", "deleted", "swept", "link_sets"]
