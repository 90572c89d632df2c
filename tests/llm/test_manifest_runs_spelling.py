"""The manifest, the repeated windows and the spelling groups against plain versions, and over odd rows."""

import re
import zlib
from collections import Counter, defaultdict
from hashlib import sha256

import numpy as np
import pytest
from pyspark.sql import functions as F

from folia.llm import spelling, super_kmers, witnesses

ROOT = "/root/testdata/sf0.001"
SCHEMA = "doc_id bigint, source string, lang string, n_chars bigint, text string"
LOWER = str.maketrans("ABCDEFGHIJKLMNOPQRSTUVWXYZ", "abcdefghijklmnopqrstuvwxyz")
LONG = " ".join(f"word{i % 977}" for i in range(30_000))
ODD = [
    (1, "a", "en", 3, LONG), (2, "a", "en", None, LONG), (3, None, None, 0, None), (None, "a", "en", 1, LONG), (4, "", "en", 0, ""),
    (5, "b", "fr", 4, "One Two three"), (5, "b", "fr", 4, "One Two three"), (6, "b", "de", 1, " \n\t "), (8, "c", "en", 7, LONG[:-4] + " Été"),
    (8, "c", "en", 7, "another text of one id " * 9), (9, "c", "en", 7, "another text of one id " * 9),
]
CLASHING = "tree pos n node altered block steps root line task mark runs at bucket window least word run id h s lo hi tail form near".split()


def tuples(df):
    return sorted(map(tuple, df.collect()), key=str)


def table(spark, rows):
    return spark.createDataFrame(rows, SCHEMA)


@pytest.fixture(scope="module")
def docs(spark):
    return spark.read.parquet(f"{ROOT}/documents.parquet").select("doc_id", "source", "lang", "n_chars", "text")


@pytest.fixture(scope="module")
def odd(spark):
    return table(spark, ODD).repartition(3)


# --- manifest ----------------------------------------------------------------------------------
def digest(text):
    return sha256(text.encode()).hexdigest()


def plain_leaf(row):
    return digest("".join("-" if v is None else f"{len(str(v).encode())}:{v}" for v in row))


def plain_tree(nodes):
    """Root and, for each leaf, its runs level by level, by building all levels at once."""
    runs_of, place, level = [[] for _ in nodes], list(range(len(nodes))), nodes
    while len(level) > 1:
        runs = [level[i : i + 16] for i in range(0, len(level), 16)]
        for j, p in enumerate(place):
            runs_of[j].append((p % 16, runs[p // 16]))
        place, level = [p // 16 for p in place], [digest("".join(r)) for r in runs]
    return level[0], runs_of


def plain_manifest(rows):
    sources = defaultdict(list)
    for r in rows:
        sources[r[1]].append(r)
    names = sorted(sources, key=lambda s: (s is not None, (s or "").encode()))
    trees = {}
    for s in names:
        sources[s].sort(key=lambda r: (r[0] is not None, r[0] or 0, plain_leaf(r)))
        trees[s] = plain_tree([plain_leaf(r) for r in sources[s]])
    root, top = plain_tree([trees[s][0] for s in names])
    for above, s in zip(top, names):
        for r, below in zip(sources[s], trees[s][1]):
            changed = r[0] is not None and r[4] is not None and zlib.crc32(str(r[0]).encode()) % 5 == 0
            node, others = plain_leaf((*r[:4], r[4].translate(LOWER)) if changed else r), ""
            for place, run in below + above:
                others += "".join(x for i, x in enumerate(run) if i != place)
                node = digest("".join(run[:place] + [node] + run[place + 1 :]))
            yield r[0], plain_leaf(r), trees[s][0], root, digest(others), node, node == root


@pytest.mark.parametrize("n", [1, 16, 17, 273, 4096, 4097])
def test_frontier_closes_runs_as_a_whole_tree_does(n):
    nodes = [digest(str(i)) for i in range(n)]
    tree = witnesses.Frontier()
    kept = [tree.append(x) for x in nodes]
    root, runs = plain_tree(nodes)
    assert tree.finish(0) == root
    for node, steps, own in list(zip(nodes, kept, runs))[:: max(1, n // 50)]:
        assert steps == [(p, "".join(x for i, x in enumerate(r) if i != p)) for p, r in own]
        assert witnesses.folded(node, steps) == root and (not steps or witnesses.folded(digest("other"), steps) != root)


def test_manifest_of_the_documents(docs):
    assert tuples(witnesses.manifest(docs)) == sorted(plain_manifest([tuple(r) for r in docs.collect()]), key=str)


def test_manifest_over_several_blocks_and_odd_rows(spark, odd):
    rows = ODD + [(i, "hot", "en", i, f"Text {i}") for i in range(5000)] + [(7, f"source{i}", None, i, "T") for i in range(40)]
    assert tuples(witnesses.manifest(table(spark, rows))) == sorted(plain_manifest(rows), key=str)
    found = witnesses.manifest(odd)
    clashing = odd.withColumns({c: F.lit("x") for c in CLASHING})
    assert tuples(witnesses.manifest(clashing)) == tuples(found) and witnesses.manifest(odd.limit(0)).collect() == []


# --- repeated windows --------------------------------------------------------------------------
def plain_removed(rows):
    words = [re.findall(r"[^\x20\x09-\x0D]+", r[4] or "") for r in rows]
    first = {}
    for r, w in zip(rows, words):
        for i in range(len(w) - 12) if r[0] is not None else ():
            key = tuple(w[i : i + 13])
            first[key] = min(first.get(key, r[0]), r[0])
    for r, w in zip(rows, words):
        gone = set()
        for i in range(len(w) - 12) if r[0] is not None else ():
            if first[tuple(w[i : i + 13])] < r[0]:
                gone.update(range(i, i + 13))
        yield r[0], len(w), len(gone), " ".join(x for i, x in enumerate(w) if i not in gone)


@pytest.mark.parametrize("limits", [(), (1 << 16,), (1 << 16, 500), (1 << 20, 0)])
def test_repeated_windows(docs, odd, limits):
    """With one bucket, several buckets, heavy slots, and every slot heavy."""
    for rows in (docs, odd):
        assert tuples(super_kmers.drop_repeated(rows, *limits)) == sorted(plain_removed([tuple(r) for r in rows.collect()]), key=str)


def test_repeated_windows_of_random_words(spark):
    rng = np.random.default_rng(5)
    rows = [(int(rng.integers(40)), "s", "en", 0, " ".join(rng.choice(list("abc"), int(rng.integers(60))))) for _ in range(300)]
    rows += [(100 + i, "s", "en", 0, " ".join(f"common{j}" for j in range(15)) + f" own{i} " * 14) for i in range(300)]
    for limits in ((1 << 12,), (1 << 12, 200)):
        assert tuples(super_kmers.drop_repeated(table(spark, rows), *limits)) == sorted(plain_removed(rows), key=str)


def test_repeated_windows_with_clashing_columns_string_ids_and_no_rows(spark, odd):
    clashing = odd.withColumns({c: F.lit("x") for c in CLASHING})
    assert tuples(super_kmers.drop_repeated(clashing)) == tuples(super_kmers.drop_repeated(odd))
    assert super_kmers.drop_repeated(odd.limit(0)).collect() == []
    named = odd.withColumn("doc_id", F.concat(F.lit("d"), F.col("doc_id").cast("string")))
    counts = sorted((r["n_words"], r["n_removed"]) for r in super_kmers.drop_repeated(named).collect())
    assert counts == sorted((r["n_words"], r["n_removed"]) for r in super_kmers.drop_repeated(odd).collect())


def test_equal_hashes_of_different_windows_are_told_apart(monkeypatch):
    monkeypatch.setattr(super_kmers, "run_hashes", lambda h, k: np.zeros(max(len(h) - k + 1, 0), dtype=np.uint64))
    lines = [" ".join(f"{c}{i}" for i in range(14)) for c in "abab"]
    words = super_kmers.Packed("\n".join([*lines, ""]).encode())
    starts, _, _ = super_kmers.windows_of(words)
    spelled = [b" ".join(words.word(i) for i in range(s, s + 13)) for s in starts]
    first = super_kmers.first_of_equal(words, starts)
    assert first.tolist() == [spelled.index(x) for x in spelled]


# --- spelling ----------------------------------------------------------------------------------
def plain_variants(rows, least=5):
    counts = Counter()
    for r in rows:
        for run in re.findall("[A-Za-zÀ-ÿ]+", r[4] or ""):
            run = run.translate(LOWER)
            h = zlib.crc32(f"{'' if r[0] is None else r[0]}:{run}".encode())
            counts[run if h % 199 else run[: h % len(run)] + run[h % len(run) + 1 :]] += 1
    n = {w: c for w, c in counts.items() if c >= least and len(w) >= 6}

    def one_edit(a, b):
        if abs(len(a) - len(b)) > 1 or a == b:
            return False
        i = next((i for i in range(min(len(a), len(b))) if a[i] != b[i]), min(len(a), len(b)))
        return a[i + (len(a) >= len(b)) :] == b[i + (len(b) >= len(a)) :]

    near = {w: [v for v in n if one_edit(w, v)] for w in n}
    form = {w: min(near[w], key=lambda v: (-n[v], v)) for w in n if near[w]}
    form = {w: f for w, f in form.items() if n[f] >= 5 * n[w]}
    for w in n:
        root = w
        while root in form:
            root = form[root]
        yield w, form.get(w), root, n[w], len(near[w]), n[form[w]] if w in form else None


@pytest.mark.parametrize("group_words", [4096, 2])
def test_variants_of_the_documents(docs, group_words):
    assert tuples(spelling.variants(docs, group_words)) == sorted(plain_variants([tuple(r) for r in docs.collect()]), key=str)


@pytest.mark.parametrize("group_words", [1000, 1])
def test_variants_of_words_that_are_all_near(spark, group_words):
    """Two letters only, repeated letters, words that are prefixes of others, and chains of forms."""
    rng = np.random.default_rng(3)
    words = {"".join(rng.choice(["a", "b", "é"], int(rng.integers(5, 9)), p=[0.6, 0.3, 0.1])) for _ in range(250)}
    words |= {"a" * 6, "a" * 7, "a" * 8, "b" * 6, "x" * 400, "x" * 401}
    text = " ".join(" ".join([w] * int(5 ** rng.uniform(1, 4))) for w in sorted(words))
    rows = [(1, "s", "en", 0, text), (2, "s", "en", 0, None), (None, "s", "en", 0, "ÀÉaaaaa Bbbbbbb " * 7), (3, "s", "en", 0, "")]
    found = tuples(spelling.variants(table(spark, rows), group_words))
    assert found == sorted(plain_variants(rows), key=str)
    assert any(r[1] is not None and r[2] != r[1] for r in found)


def test_variants_over_odd_rows(odd):
    found = tuples(spelling.variants(odd))
    assert found == sorted(plain_variants(ODD), key=str)
    assert tuples(spelling.variants(odd.withColumns({c: F.lit("x") for c in CLASHING}))) == found
    assert spelling.variants(odd.limit(0)).collect() == []
