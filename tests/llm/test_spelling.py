"""Spelling variants against all pairs of words."""

import random
import re
import zlib
from collections import Counter

import pytest

from llm_cases import LONG, ODD, SF, docs_of  # noqa: F401
from logsift.llm import spelling as S
from logsift.llm.common import read_table

LOWER = str.maketrans({chr(65 + i): chr(97 + i) for i in range(26)})


def brute_counts(rows):
    counts = Counter()
    for i, t in rows:
        for w in re.findall("[A-Za-zÀ-ÿ]+", t or ""):
            w = w.translate(LOWER)
            h = zlib.crc32(f"{'' if i is None else i}:{w}".encode())
            if h % 31 == 0:
                w = w[:h % len(w)] + w[h % len(w) + 1:]
            counts[w] += 1
    return {w: n for w, n in counts.items() if len(w) >= 7 and n >= 2}


def edits(w, alphabet):
    """All that differ from w by one inserted, deleted or replaced letter."""
    out = {w[:i] + w[i + 1:] for i in range(len(w))}
    out |= {w[:i] + c + w[i + 1:] for i in range(len(w)) for c in alphabet}
    out |= {w[:i] + c + w[i:] for i in range(len(w) + 1) for c in alphabet}
    return out - {w}


def brute(counts):
    alphabet, form, near = set("".join(counts)), {}, {}
    for w, n in counts.items():
        near[w] = edits(w, alphabet) & counts.keys()
        best = min(near[w], key=lambda x: (-counts[x], x), default=None)
        form[w] = best if best and counts[best] >= 10 * n else None
    out = []
    for w, n in counts.items():
        root = w
        while form[root]:
            root = form[root]
        out.append((w, form[w], root, n, len(near[w]), counts[form[w]] if form[w] else None))
    return sorted(out, key=str)


def got(df):
    return sorted((tuple(r) for r in df.collect()), key=str)


def test_whole_table(spark):
    docs = read_table(spark, SF, "documents", "doc_id", "text")
    counts = brute_counts([(r.doc_id, r.text) for r in docs.collect()])
    assert len(counts) > 500
    assert got(S.spelling_variants(docs)) == brute(counts)


@pytest.mark.parametrize("range_chars", [40, 400, 2_000_000])
def test_close_words_over_many_ranges(spark, monkeypatch, range_chars):
    """Words of few letters, so with many neighbours, runs of one letter and chains of forms; ranges of a few words."""
    monkeypatch.setattr(S, "RANGE_CHARS", range_chars)
    rng = random.Random(range_chars)
    words = {"".join(rng.choice("abé") for _ in range(rng.randint(7, 10))) for _ in range(300)}
    words |= {"a" * 7, "a" * 8, "a" * 9, "ÿ" * 9, "abcdefgh", "abcdefg", "abcdefghi"}
    counts = {w: 10 ** rng.randint(0, 7) * rng.choice([2, 3, 10]) for w in words}
    df = spark.createDataFrame(list(counts.items()), "word string, n long")
    assert got(S.variants(df)) == brute(counts)


def test_nodes_are_those_of_one_trie():
    """However the words are cut into ranges, two words share a node exactly if they share the prefix."""
    rng = random.Random(5)
    words = sorted({"".join(rng.choice("ab") for _ in range(rng.randint(1, 6))) for _ in range(60)} | {"abababababab"})
    for size in (1, 2, 7, 100):
        ranges = [words[a:a + size] for a in range(0, len(words), size)]
        first = S.border_nodes([(k, r[0], r[-1]) for k, r in enumerate(ranges)])
        node = {}
        for k, r in enumerate(ranges):
            for w, nodes in zip(r, S.range_nodes(k, r, first[k])):
                assert len(nodes) == len(w) + 1
                for i, x in enumerate(nodes):
                    assert node.setdefault(w[:i], x) == x
        assert len(set(node.values())) == len(node)


def test_odd_rows(docs_of):
    odd = ODD + [(20, "Straßenbahn STRAßENBAHN straßenbahn Étudiant étudiant ETUDIANT etudiant"), (None, "governments Government's governments"),
                 (21, "x" * 30_000 + " " + "x" * 30_000), (22, "y" + "x" * 30_000 + " y" + "x" * 30_000), (21, "short word")]
    counts = brute_counts(odd)
    by = {w: (f, r, n, near) for w, f, r, n, near, _ in got(S.spelling_variants(docs_of(odd)))}
    assert by.keys() == counts.keys() and all(by[w][2] == n for w, n in counts.items())
    long_words = [w for w in by if len(w) >= 29_999]
    assert all(by[w][3] == len(long_words) - 1 for w in long_words if len(long_words) == 2)
    assert got(S.spelling_variants(docs_of([]))) == [] and got(S.spelling_variants(docs_of([(1, None), (2, "a b")]))) == []
