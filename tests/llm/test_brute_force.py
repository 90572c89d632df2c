"""The operators against plain, slow versions of the same contract."""

import hashlib
import random
import re
import zlib
from collections import Counter, defaultdict

import pytest

from folia.llm import html_marginals, line_crf, line_templates, order_minhash, packing, pii, sharding, signals, toxicity, weak_quality, winnowing

ROOT = "/root/testdata/sf0.001"


@pytest.fixture(scope="module")
def docs(spark):
    return spark.read.parquet(f"{ROOT}/documents.parquet")


@pytest.fixture(scope="module")
def texts(docs):
    return {r["doc_id"]: r["text"] or "" for r in docs.collect()}


@pytest.fixture(scope="module")
def labels(spark):
    return spark.read.parquet(f"{ROOT}/labels.parquet")


def prose(rng, n, words=None):
    words = words or [f"{a}{b}{c}" for a in ("ka", "lo", "mi", "tre") for b in ("ren", "sta", "vo", "qui") for c in ("", "n", "ble", "dor")]
    return [rng.choice(words) for _ in range(n)]


# --- sharding ----------------------------------------------------------------------------------
def test_shards(docs, texts):
    rows = sharding.shard(docs, 24).collect()
    assert len(rows) == len(texts)
    total, slots = Counter(), defaultdict(list)
    for r in rows:
        data = texts[r["doc_id"]].encode()
        assert (r["size"], r["text_crc32"], r["law"], r["grown_shard"]) == (len(data) + 8, zlib.crc32(data), "bytes", None)
        total[r["shard"]] += r["size"]
        slots[r["shard"]].append(r["slot"])
    assert sorted(total) == list(range(24))
    assert all(sorted(s) == list(range(len(s))) for s in slots.values())
    assert max(total.values()) - min(total.values()) <= 2 * max(r["size"] for r in rows)


def test_one_hot_source_is_split_evenly(spark):
    rows = [(i, "x" * (50 + i % 7), "en", "hot" if i % 3 else f"s{i}") for i in range(3000)]
    found = sharding.shard(spark.createDataFrame(rows, "doc_id bigint, text string, lang string, source string"), 7).collect()
    total = Counter()
    for r in found:
        total[r["shard"]] += r["size"]
    mean = sum(total.values()) / 7
    assert max(abs(v - mean) for v in total.values()) < 0.02 * mean


def test_equal_texts_share_a_shard_unless_they_outweigh_one(spark):
    rng = random.Random(4)
    rows = [(i, " ".join(prose(rng, 30)), "en", f"s{i % 5}") for i in range(1500)]
    copied = [(" ".join(prose(rng, 30)), rng.choice([2, 3, 9, 40])) for _ in range(60)] + [(" ".join(prose(rng, 30)), 1200)]
    rows += [(2000 + i, text, "en", f"s{i % 5}") for i, text in enumerate(t for t, n in copied for _ in range(n))]
    rows += [(9000 + i, text, None, None) for i, text in enumerate([None, "", None])]
    found = sharding.shard(spark.createDataFrame(rows, "doc_id bigint, text string, lang string, source string"), 8).collect()
    assert len(found) == len(rows)
    total, text_of, places = Counter(), {r[0]: r[1] or "" for r in rows}, defaultdict(set)
    weight = Counter()
    for r in found:
        total[r["shard"]] += r["size"]
        places[text_of[r["doc_id"]]].add(r["shard"])
        weight[text_of[r["doc_id"]]] += r["size"]
    mean = sum(total.values()) / 8
    assert all(len(at) == 1 for text, at in places.items() if weight[text] <= mean)
    assert any(len(at) > 1 for at in places.values())
    assert max(abs(v - mean) for v in total.values()) < 0.03 * mean


def test_tree_cuts_the_widest_dimension(spark):
    rows = [(i, "x" * (2 ** (i % 12)), "en", "one") for i in range(2000)]
    docs = spark.createDataFrame(rows, "doc_id bigint, text string, lang string, source string")
    slim = sharding._with_id_place(sharding._slim(docs), "bigint").cache()
    cuts = sharding.build_tree(slim, 4)
    assert set(cuts) == {0, 1, 2} and {c.dimension for c in cuts.values()} <= {"d_size", "d_id"}


# --- personal data -----------------------------------------------------------------------------
EMAIL, IP = r"[A-Za-z0-9._%+-]+@[A-Za-z0-9-]+(\.[A-Za-z0-9-]+)+", r"[0-9]+(\.[0-9]+)(\.[0-9]+)(\.[0-9]+)"
CARD, PHONE = r"[0-9]([\x20-]?[0-9])+", r"\+[0-9][\x20().0-9-]+[0-9]"


def plain_base(text):
    def digits(s):
        return re.sub("[^0-9]", "", s)

    def luhn(d):
        return sum(sum(divmod(int(c) * (1 + k % 2), 10)) for k, c in enumerate(reversed(d))) % 10 == 0

    ok = {
        "email": lambda s: True,
        "ip": lambda s: all(int(p) <= 255 for p in s.split(".")),
        "card": lambda s: 16 <= len(digits(s)) <= 19 and luhn(digits(s)),
        "phone": lambda s: 8 <= len(digits(s)) <= 15,
    }
    return [(k, *m.span()) for k, p in zip(ok, (EMAIL, IP, CARD, PHONE)) for m in re.finditer(p, text) if ok[k](m[0])]


def test_base_spans_of_random_strings():
    rng = random.Random(1)
    pieces = ["a@b.co", "@", "x.y@z", "@q.r-s.t", "1.2.3.4", "256.1.1.1", ".5", "4111 1111-1111 1111", "4111111111111111", "+1 (417) 555-3020", "+4", "--", " ", "7", "é", "1.1.1.1.1.1.1.1", "0", "+", "()", "00300.0.0.1", "\n"]
    for _ in range(4000):
        text = "".join(rng.choice(pieces) for _ in range(rng.randrange(12)))
        assert pii.base_spans(text) == plain_base(text), text


def test_patterns_find_what_their_plain_forms_find():
    plain = {
        "IP": r"(?<![0-9])[0-9]++(?:\.[0-9]++){3}",
        "CARD": r"(?<![0-9])[0-9](?:[ -]?[0-9])++",
        "IBAN": r"(?<![A-Za-z0-9])[A-Z]{2}[0-9]{2}(?: ?[A-Z0-9]){11,30}",
        "LOCAL_PHONE": r"(?<![0-9+)(.-])\(?[0-9]{3}\)?[ .-][0-9]{3}[ .-][0-9]{4}(?![0-9-])",
    }
    rng = random.Random(2)
    pieces = ["417", "555", "3020", "(417)", "(", ")", " ", "-", ".", "+", "1.2.3", "GB82", "WEST12345698765432", "A", "z", "7", "é", "٣", "\n"]
    for _ in range(20000):
        text = "".join(rng.choice(pieces) for _ in range(rng.randrange(14)))
        for name, pattern in plain.items():
            assert [m.span() for m in getattr(pii, name).finditer(text)] == [m.span() for m in re.finditer(pattern, text)], (name, text)


def test_only_texts_that_can_hold_personal_data_reach_python(spark):
    rows = [(1, "no such thing ٣ ５"), (2, None), (3, ""), (4, "a@b.co"), (5, "at 1.2.3.4"), (6, "line\nx@y.zz\n")]
    found = pii.find_personal_data(spark.createDataFrame(rows, "doc_id int, text string"))
    plan = found._jdf.queryExecution().executedPlan().toString()
    assert "RLIKE" in plan[plan.index("MapInArrow") :]
    got = {r["doc_id"]: (r["spans"], r["base_sha256"]) for r in found.collect()}
    want = {1: "", 2: "", 3: "", 4: "email:0:6", 5: "ip:3:10", 6: "email:5:11"}
    assert got == {k: (v, hashlib.sha256(v.encode()).hexdigest()) for k, v in want.items()}


def test_personal_data_of_documents(docs, texts):
    for r in pii.find_personal_data(docs).collect():
        base = plain_base(texts[r["doc_id"]])
        assert [r[f"n_{k}"] for k in pii.KINDS] == [sum(s[0] == k for s in base) for k in pii.KINDS]
        listed = ",".join(f"{k}:{a}:{b}" for k, a, b in base)
        assert r["base_sha256"] == hashlib.sha256(listed.encode()).hexdigest()
        assert set(filter(None, listed.split(","))) <= set(filter(None, r["spans"].split(",")))


def test_context_and_checksums():
    assert pii.mod97("GB82WEST12345698765432") and not pii.mod97("GB83WEST12345698765432")
    text = "pay to GB82 WEST 1234 5698 7654 32 now"
    assert pii.joined(pii.added_spans(text, [])) == "iban:7:34"
    amex = "378282246310005"
    assert pii.added_spans(f"number {amex}", []) == []
    assert pii.added_spans(f"my card is {amex}", []) == [("card", 11, 26)]
    assert pii.added_spans("call 417-555-3020", []) == [("phone", 5, 17)] and pii.added_spans("part 417-555-3020", []) == []


# --- near copies -------------------------------------------------------------------------------
def test_edit_distance_within_band():
    def distance(a, b):
        row = list(range(len(b) + 1))
        for i, x in enumerate(a, 1):
            row, last = [i], row
            for j, y in enumerate(b, 1):
                row.append(min(last[j] + 1, row[-1] + 1, last[j - 1] + (x != y)))
        return row[-1]

    rng = random.Random(2)
    for _ in range(600):
        a = [rng.randrange(4) for _ in range(rng.randrange(14))]
        b = [rng.randrange(4) for _ in range(rng.randrange(14))] if rng.random() < 0.5 else [x for x in a if rng.random() < 0.9]
        d = distance(a, b)
        for band in range(8):
            assert order_minhash.edits_within(a, b, band) == (d <= band)


def words_of(text):
    return re.findall(r"[^\x00-\x2F\x3A-\x60\x7B-\x7F]+", re.sub("[A-Z]", lambda m: m[0].lower(), text))


def shingles(text):
    w = words_of(text)
    return {tuple(w[i : i + 5]) for i in range(max(1, len(w) - 4))} if w else set()


def test_near_copies_have_one_class(spark):
    rng = random.Random(3)
    vocabulary = [f"w{i}" for i in range(5000)]
    texts = []
    for group in range(12):
        base = prose(rng, rng.randrange(60, 400), vocabulary)
        texts.append(base)
        for _ in range(rng.randrange(8)):
            copy = base[:]
            for _ in range(max(1, int(len(base) * rng.choice((0.005, 0.01, 0.02, 0.04, 0.2))))):
                copy[rng.randrange(len(copy))] = rng.choice(vocabulary)
            texts.append(copy)
    passage = prose(rng, 60, vocabulary)
    texts += [prose(rng, 150, vocabulary) + passage + prose(rng, 100, vocabulary) for _ in range(60)]
    rows = [(i, " ".join(t)) for i, t in enumerate(texts)]
    rows += [(len(rows) + i, rows[0][1]) for i in range(30)]
    found = {r["doc_id"]: r["class_id"] for r in order_minhash.near_duplicates(spark.createDataFrame(rows, "doc_id bigint, text string").repartition(4)).collect()}
    assert found == near_classes(rows)


def near_classes(rows):
    sets = {i: shingles(t) for i, t in rows}
    parent = {i: i for i in sets}

    def root(i):
        while parent[i] != i:
            i = parent[i]
        return i

    for a in sets:
        for b in range(a):
            if len(sets[a] & sets[b]) >= 0.8 * len(sets[a] | sets[b]):
                parent[max(root(a), root(b))] = min(root(a), root(b))
    return {i: root(i) for i in sets}


def test_large_groups_around_the_similarity(spark):
    """Copies of a text that lie on both sides of the similarity, chains between them, and a group without its original."""
    rng = random.Random(8)
    vocabulary = [f"w{i}" for i in range(5000)]
    texts = []
    for words, edits in ((150, (1, 2, 3, 4, 5, 6, 8)), (90, (2, 3, 4))):
        base = prose(rng, words, vocabulary)
        for _ in range(160):
            copy = base[:]
            for _ in range(rng.choice(edits)):
                copy[rng.randrange(len(copy))] = rng.choice(vocabulary)
            texts.append(copy)
        for _ in range(20):  # copies of copies
            copy = rng.choice(texts)[:]
            copy[rng.randrange(len(copy))] = rng.choice(vocabulary)
            texts.append(copy + prose(rng, rng.randrange(4), vocabulary))
    rng.shuffle(texts)
    rows = [(i, " ".join(t)) for i, t in enumerate(texts)]
    wanted = near_classes(rows)
    assert 20 < len(set(wanted.values())) < 300
    found = order_minhash.near_duplicates(spark.createDataFrame(rows, "doc_id bigint, text string").repartition(4)).collect()
    assert {r["doc_id"]: r["class_id"] for r in found} == wanted


def test_account_numbers_end_at_their_length():
    long, plain = "GB82 WEST 1234 5698 7654 32", "GB82WEST12345698765432"
    for account, after in ((long, " BIC NWBKGB2L"), (plain, " EUR 100"), ("DE89 3704 0044 0532 0130 00", " 2024"), (plain, ""), (plain, " now")):
        assert pii.added_spans(f"to {account}{after}", []) == [("iban", 3, 3 + len(account))]
    assert pii.added_spans(f"{plain} {plain}", []) == [("iban", 0, 22), ("iban", 23, 45)]
    assert pii.added_spans(f"to {plain}X", []) == []


# --- toxicity ----------------------------------------------------------------------------------
def test_automaton_accepts_one_edit_of_long_terms():
    match = toxicity.Automaton({"disgusting ": 2.0, "scum ": 1.5, "veju": 1.0})
    assert match("disgusting") == (2.0, False) and match("scum") == (1.5, False)
    for word in ("disgustng", "disguusting", "disgustimg", "disgustin"):
        assert match(word) == (2.0, True), word
    for word in ("scam", "scums", "disgustng0x", "isgusting", "dsgstng", "the", "vej", "aveju"):
        assert match(word)[0] == 0, word
    assert match("vejuaire") == (1.0, False)


def test_automaton_exchanges_and_weak_beginnings():
    match = toxicity.Automaton({"disgusting ": 2.0, "disgusted ": 1.0, "dis": 0.5, "scum ": 1.5})
    for word in ("disgutsing", "dsigusting", "disgustign", "disguusting"):
        assert match(word) == (2.0, True), word
    assert match("disco") == (0.5, False) and match("sucm")[0] == 0 and match("dsigustign")[0] == 0


def test_misspelt_words_of_the_learned_lexicon(spark):
    rng = random.Random(21)
    rows, marks = [], []
    for i in range(240):
        words = prose(rng, 40)
        if i % 3 == 0:
            words[rng.randrange(40)] = rng.choice(("disgusting", "worthless", "pathetic", "disgrace"))
        rows.append((i, " ".join(words)))
        marks.append((i, int(i % 3 == 0)))
    docs, labels = spark.createDataFrame(rows, "doc_id bigint, text string"), spark.createDataFrame(marks, "doc_id bigint, toxic int")
    model = toxicity.train(docs, labels)
    wrong = ("dsgusting", "wrothless", "wortless", "patehtic", "pathetik", "disggusting")
    asked = [(k, " ".join([*prose(rng, 20), w, *prose(rng, 20)])) for k, w in enumerate(wrong)] + [(100 + k, " ".join(prose(rng, 40))) for k in range(6)]
    found = {r["doc_id"]: r["predicted"] for r in toxicity.score(spark.createDataFrame(asked, "doc_id bigint, text string"), model).collect()}
    assert found == {k: int(k < 100) for k, _ in asked}


def test_quotation_weighs_less():
    match = toxicity.Automaton({"disgusting ": 2.0})
    plain = toxicity.features("what a disgusting thing", match)
    quoted = toxicity.features('they said "disgusting" about it', match)
    addressed = toxicity.features("you disgusting thing", match)
    assert quoted[1] < plain[1] < addressed[1]


def test_held_out_toxicity(spark):
    root = "/root/testdata/sf0.1"
    docs, labels = spark.read.parquet(f"{root}/documents.parquet"), spark.read.parquet(f"{root}/labels.parquet")
    scored = toxicity.score(docs, toxicity.train(docs, labels)).join(labels, "doc_id").filter("held_out")
    rows = scored.select("predicted", "toxic", "score").collect()
    assert all(0 <= r["score"] <= 1 for r in rows)
    right = Counter((r["toxic"], r["predicted"]) for r in rows)
    assert right[1, 1] >= 0.8 * (right[1, 1] + right[1, 0]) and right[0, 1] <= 0.03 * (right[0, 0] + right[0, 1])


# --- packing -----------------------------------------------------------------------------------
def test_packing_holds_every_piece_once(docs, texts):
    rows = packing.best_fit(docs, (64, 256, 512), group_length=20_000).collect()
    bins, by_doc = defaultdict(list), defaultdict(list)
    for r in rows:
        by_doc[r["doc_id"]].append((r["start"], r["length"]))
        if r["length"]:
            bins[r["bin"]].append((r["offset"], r["length"], r["capacity"]))
    for doc_id, text in texts.items():
        at = 0
        for start, length in sorted(by_doc[doc_id]):
            assert start == at and length <= 512
            at += length
        assert at == len(re.findall(r"[^ \t\n\x0b\f\r]+", text))
    for content in bins.values():
        at = 0
        for offset, length, capacity in sorted(content):
            assert offset == at
            at += length
        assert capacity == min(c for c in (64, 256, 512) if c >= at)
    assert sum(c[0][2] for c in bins.values()) <= 1.05 * sum(r["length"] for r in rows)


def test_best_fit_takes_the_tightest_bin_and_several_sizes():
    places, final, filled = packing.best_packing([70, 60, 40, 30], (100,))
    assert places == [(0, 0), (1, 0), (1, 60), (0, 70)] and filled == [100, 100]
    places, final, _ = packing.best_packing([900, 100, 40], (64, 128, 1024))
    assert sum(final) <= 1024 + 64


# --- quality rules -----------------------------------------------------------------------------
def plain_counts(text):
    words = re.findall(r"[^\x20\x09-\x0D]+", text)
    seen, copies = set(), 0
    for line in text.split("\n"):
        if re.search(r"[^\x20\x09-\x0D]", line):
            copies += line in seen
            seen.add(line)
    windows = [tuple(words[i : i + 3]) for i in range(len(words) - 2)]
    often = Counter(windows)
    repeated = {j for i, w in enumerate(windows) if often[w] > 1 for j in range(i, i + 3)}
    return len(words), sum(map(len, words)), len(re.findall(r"[#*$%&|<>]", text)), copies, len(repeated)


def test_counts_of_random_texts():
    rng = random.Random(5)
    texts = ["".join(rng.choice("ab é\n\t#|\x00\U0001f600  c") for _ in range(rng.randrange(80))) for _ in range(800)] + [None, ""]
    s = signals.Signals(texts)
    for i, text in enumerate(texts):
        found = (s.n_words[i], s.word_chars[i], s.n_symbols[i], s.n_dup_lines[i], s.n_repeat_words[i])
        assert found == plain_counts(text or ""), text


def test_viterbi_is_the_best_labelling():
    import itertools

    import numpy as np

    rng = np.random.default_rng(7)
    for _ in range(60):
        n = int(rng.integers(1, 8))
        scores, moves = rng.normal(size=n), rng.normal(size=(2, 2))

        def value(labels):
            return sum(s for s, y in zip(scores, labels) if y) + sum(moves[a, b] for a, b in zip(labels, labels[1:]))

        best = max(itertools.product((0, 1), repeat=n), key=value)
        assert tuple(line_crf.decode(scores, moves).astype(int)) == best


def test_gradient_of_the_line_field():
    import numpy as np

    rng = np.random.default_rng(8)
    chains, labels = [rng.normal(size=(n, 12)) for n in (1, 3, 5)], [0, 1, 1]
    length = max(map(len, chains))
    x, live = np.zeros((3, length, 12)), np.zeros((3, length), dtype=bool)
    for i, c in enumerate(chains):
        x[i, : len(c)], live[i, : len(c)] = c, True

    def likelihood(w, moves):
        import itertools

        total = 0.0
        for c, y in zip(chains, labels):
            def value(z):
                return sum(c[t] @ w for t in range(len(c)) if z[t]) + sum(moves[a, b] for a, b in zip(z, z[1:]))

            total += value([y] * len(c)) - np.log(sum(np.exp(value(z)) for z in itertools.product((0, 1), repeat=len(c))))
        return total / 3

    w, moves = rng.normal(size=12), rng.normal(size=(2, 2))
    gw, gm = line_crf._gradient(x, live, np.array(labels), w, moves)
    for k in range(12):
        step = np.eye(12)[k] * 1e-5
        assert abs((likelihood(w + step, moves) - likelihood(w - step, moves)) / 2e-5 - gw[k]) < 1e-5
    for a in range(2):
        for b in range(2):
            step = np.zeros((2, 2))
            step[a, b] = 1e-5
            assert abs((likelihood(w, moves + step) - likelihood(w, moves - step)) / 2e-5 - gm[a, b]) < 1e-5


def test_quality_of_documents(spark, docs, texts, labels):
    rows = line_crf.quality(docs, line_crf.train(docs, labels)).collect()
    for r in rows:
        counts = plain_counts(texts[r["doc_id"]])
        assert (r["n_words"], r["word_chars"], r["n_symbols"], r["n_dup_lines"], r["n_repeat_words"]) == counts
        assert r["base_failed"] == (counts[0] < 50 or 100 * counts[4] > 50 * counts[0]) and not (r["base_failed"] and r["kept"])
    verdict = {r["doc_id"]: r for r in rows}
    good = [verdict[x["doc_id"]] for x in labels.filter("quality = 1").collect()]
    assert sum(r["kept"] or r["base_failed"] for r in good) >= 0.97 * len(good)


def test_kept_rows_are_the_ones_that_stay(docs, labels):
    model = line_crf.train(docs, labels)
    kept = {r["doc_id"] for r in line_crf.quality(docs, model).filter("kept").collect()}
    assert {r["doc_id"] for r in line_crf.passing(docs, model).collect()} == kept


# --- quality classifier ------------------------------------------------------------------------
def test_expectation_maximisation_finds_the_labellers():
    import numpy as np

    rng = np.random.default_rng(9)
    truth = rng.random(6000) < 0.7
    votes = np.empty((6000, 8), dtype=np.int64)
    right = np.array([0.95, 0.9, 0.85, 0.8, 0.75, 0.9, 0.7, 0.9])
    for j, a in enumerate(right):
        says = np.where(rng.random(6000) < a, truth, ~truth)
        votes[:, j] = np.where(rng.random(6000) < 0.2, 1, 2 * says)
    patterns, counts = np.unique(weak_quality.pattern_of(votes), return_counts=True)
    assert (weak_quality.votes_of(weak_quality.pattern_of(votes)) == votes).all()
    table, share = weak_quality.estimate(patterns, counts.astype(float))
    assert abs(share - truth.mean()) < 0.03
    assert np.abs(table[1, :, 2] / (table[1, :, 2] + table[1, :, 0]) - right).max() < 0.05


def test_weak_labels_agree_with_given_ones(spark, labels):
    root = "/root/testdata/sf0.01"
    docs, labels = spark.read.parquet(f"{root}/documents.parquet"), spark.read.parquet(f"{root}/labels.parquet")
    rows = weak_quality.score(docs, weak_quality.train(docs)).join(labels, "doc_id").collect()
    good, bad = ([r for r in rows if r["quality"] == q] for q in (1, 0))
    assert sum(r["kept"] for r in good) >= 0.97 * len(good)
    assert sum(r["score"] for r in good) / len(good) > sum(r["score"] for r in bad) / len(bad) + 0.1


# --- line dedup --------------------------------------------------------------------------------
@pytest.mark.parametrize("sent_bytes", [1 << 20, 0])
def test_recurring_templates_are_dropped_but_for_the_first(spark, sent_bytes):
    rng = random.Random(11)
    rows = []
    for i in range(40):
        lines = [" ".join(prose(rng, 12)) for _ in range(6)]
        if i % 2:
            lines.insert(3, f"Page generated on server {i} at request {i * 7} of the site")
        if i % 4 == 0:
            lines.append("All rights are reserved by the owner of this page")
        rows.append((i, "\n".join(lines)))
    copied = "\n".join(" ".join(prose(rng, 12)) for _ in range(8))
    rows += [(100 + i, copied) for i in range(30)]
    docs = spark.createDataFrame(rows, "doc_id bigint, text string").repartition(4)
    kept = {r["doc_id"]: r["text"] for r in line_templates.drop_recurring_lines(docs, sent_bytes=sent_bytes).collect()}
    for i, text in rows:
        lines = text.split("\n")
        if i < 100:
            lines = [x for x in lines if not (x.startswith("Page generated") and i != 1) and not (x.startswith("All rights") and i != 0)]
        assert kept[i] == "\n".join(lines)


def test_recurring_lines_of_any_hash_are_dropped(spark):
    rng = random.Random(12)
    shared = [" ".join(prose(rng, 9)) for _ in range(40)]
    rows = []
    for i, line in enumerate(shared):
        rows += [(100 * i + j, "\n".join([line, *(" ".join(prose(rng, 12)) for _ in range(3))])) for j in range(12)]
        rows.append((100 * i + 12, line))
    docs = spark.createDataFrame(rows, "doc_id bigint, text string")
    kept = {r["doc_id"]: r["text"].split("\n") for r in line_templates.drop_recurring_lines(docs).collect()}
    for doc_id, text in rows:
        line = shared[doc_id // 100]
        assert kept[doc_id] == [x for x in text.split("\n") if x != line or doc_id % 100 == 0] or (text == line and kept[doc_id] == [""])


@pytest.mark.parametrize("task_lines", [1024, 0])
def test_lines_of_one_leaf_do_not_hide_each_other(spark, task_lines):
    rng = random.Random(13)

    def opening(n):
        return "This is a " + " ".join(prose(rng, n)[:n])

    shared, rows = [opening(6) for _ in range(4)], []
    for i in range(160):
        lines = [" ".join(prose(rng, 12)) for _ in range(3)] + [opening(6) for _ in range(4)]
        if i < 48:
            lines.append(shared[i % 4])
        rows.append((i, "\n".join(lines)))
    docs = spark.createDataFrame(rows, "doc_id bigint, text string")
    found = line_templates.templates(docs, task_lines=task_lines).collect()
    assert sorted((" ".join(r["fixed"]), r["first_id"]) for r in found) == sorted((x, i) for i, x in enumerate(shared))
    kept = {r["doc_id"]: r["text"] for r in line_templates.drop_recurring_lines(docs).collect()}
    for i, text in rows:
        assert kept[i] == "\n".join(x for x in text.split("\n") if x not in shared or i < 4)


@pytest.mark.parametrize("sent_bytes", [1 << 20, 0])
def test_every_line_of_enough_documents_is_dropped_short_ones_too(spark, sent_bytes):
    """Against a count of the documents with different other lines."""
    rng = random.Random(14)
    common = ["Home", "All rights reserved.", "Read more", "1 2", "Terms of use apply", *(" ".join(prose(rng, n)) for n in (6, 8, 11, 30))]
    rows = []
    for i in range(120):
        lines = [" ".join(prose(rng, 14)) for _ in range(4)]
        lines += [x for j, x in enumerate(common) if i % 11 == j]
        rng.shuffle(lines)
        rows.append((i, "\n".join(["", *lines])))
    docs = spark.createDataFrame(rows, "doc_id bigint, text string").repartition(3)
    where = defaultdict(list)
    for i, text in rows:
        for line in set(text.split("\n")) - {""}:
            where[line].append(i)
    again = {x: min(ids) for x, ids in where.items() if len(ids) >= 5}
    assert set(again) == set(common)
    kept = {r["doc_id"]: r["text"] for r in line_templates.drop_recurring_lines(docs, sent_bytes=sent_bytes).collect()}
    for i, text in rows:
        assert kept[i] == "\n".join(x for x in text.split("\n") if again.get(x, i) == i)


def test_leaf_masks_variable_fields():
    assert line_templates.leaf_of("on 2024-01-02 we met here".split()) == line_templates.leaf_of("on 17 we sat down".split())
    assert line_templates.leaf_of("a b c d e".split()) != line_templates.leaf_of("a b c d e f".split())


# --- decontamination ---------------------------------------------------------------------------
def plain_hits(text, items):
    words = words_of(text)
    hit, found = set(), set()
    for item, other in items:
        w = words_of(other or "")
        k = min(10, len(w))
        windows = {tuple(w[i : i + k]) for i in range(len(w) - k + 1)} if k else set()
        for i in range(len(words) - k + 1) if k else ():
            if tuple(words[i : i + k]) in windows:
                hit |= set(range(i, i + k))
                found.add(str(item))
    return len(words), len(hit), len(found), hashlib.sha256(",".join(sorted(found)).encode()).hexdigest(), bool(hit)


@pytest.mark.parametrize("block_bytes", [1 << 20, 300])
def test_decontamination_of_random_texts(spark, block_bytes):
    rng = random.Random(13)
    small = ["the", "of", "a", "Re", "tion", "x1"]
    items = [(i, " ".join(prose(rng, rng.choice((1, 2, 3, 5, 8, 9, 10, 11, 14, 25)), small if i % 3 else None))) for i in range(25)]
    rows = []
    for i in range(120):
        words = prose(rng, rng.randrange(60), small if i % 2 else None)
        if i % 3 == 0:
            item = rng.choice(items)[1].split()
            a = rng.randrange(len(item))
            at = rng.randrange(len(words) + 1)
            words[at:at] = item[a : a + rng.randrange(1, 30)]
        rows.append((i, rng.choice((" ", ", ", "\n")).join(words)))
    found = winnowing.decontaminate(
        spark.createDataFrame(rows, "doc_id bigint, text string"), spark.createDataFrame(items, "item_id bigint, text string"), block_bytes=block_bytes
    ).collect()
    expected = {i: plain_hits(t, items) for i, t in rows}
    assert {r["doc_id"]: tuple(r)[1:] for r in found} == expected


# --- pages -------------------------------------------------------------------------------------
def test_main_text_of_pages(spark):
    import html as entities

    pages = spark.read.parquet(f"{ROOT}/pages.parquet")
    found = {r["page_id"]: r["text"] for r in html_marginals.extract(pages, html_marginals.train(pages)).collect()}
    for r in pages.collect():
        body = re.search(r"<article>(.*?)(</article>|$)", r["html"], re.S)[1].replace("<br>", " ")
        blocks = (" ".join(entities.unescape(re.sub("<[^>]*>", "", b)).split()) for b in re.split("</?(?:p|h1)>", body))
        assert found[r["page_id"]] == "\n".join(b for b in blocks if b)


ARTICLE = "The delta grows every year, and the boats follow the new channels toward the open sea."


@pytest.mark.parametrize(
    "source",
    [
        f"<body><nav><a href=x>Home</a></nav><article><h1>Delta</h1><p>{ARTICLE}</p><aside>Related stories</aside><div class='comments'><p>Nice piece, thanks!</p></div></article><footer>c</footer></body>",
        f"<body><header><h2>Site</h2></header><div id='sidebar'><p>Popular</p></div><main><h1>Delta</h1><p>{ARTICLE}<form><p>Search it</p></form></main></body>",
        f"<body><div class=menu><ul><li><a href=a>One</a><li><a href=b>Two</a></ul></div><div class='content'><h1>Delta</h1><p>{ARTICLE}</p></div><div class='cookie-notice'><p>We use cookies.</p></div><script>x='<p>';</script></body>",
        f"<article><h1>Del<b>ta</b></h1>\n<p>{ARTICLE.replace(' ', chr(10) + '  ')}<p class='ad'>Buy now</article><style>p{{}}</style>",
    ],
)
def test_boilerplate_goes(spark, source):
    pages = spark.read.parquet(f"{ROOT}/pages.parquet")
    model = html_marginals.train(pages)
    assert html_marginals.main_text(source, model) == f"Delta\n{ARTICLE}"


def test_messages_give_exact_marginals():
    import itertools
    import math

    page = html_marginals.Page("<div class=content><p>one, two. three<a>four</a></p><ul><li>five<li>six</ul></div>")
    got = html_marginals.marginals(page, {})
    features = html_marginals.node_features(page)
    n = len(page.tag)
    node = [-60.0 if i == 0 or page.clamped[i] else sum(html_marginals.PRIORS.get(f, 0.0) for f in features[i]) for i in range(n)]
    weight = [0.0] * n
    total = 0.0
    for z in itertools.product((0, 1), repeat=n):
        score = sum(x for x, y in zip(node, z) if y)
        for i in range(1, n):
            kind = html_marginals._edge_kind(page, i)
            prior = html_marginals.AGREE[kind]
            odds = prior if z[page.parent[i]] else -prior
            score += (odds if z[i] else 0.0) - math.log1p(math.exp(odds))
        p = math.exp(score)
        total += p
        for i in range(n):
            weight[i] += p * z[i]
    assert all(abs(weight[i] / total - got[i]) < 1e-9 for i in range(n))


def test_latent_labels_of_the_line_field():
    import itertools

    import numpy as np

    rng = np.random.default_rng(12)
    x, y = rng.normal(size=(1, 5, 4)), np.array([[1, -1, 0, -1, 1]])
    live = np.ones((1, 5), dtype=bool)

    def likelihood(w, moves):
        def value(z):
            return sum(x[0, t] @ w for t in range(5) if z[t]) + sum(moves[a, b] for a, b in zip(z, z[1:]))

        every = list(itertools.product((0, 1), repeat=5))
        fitting = [z for z in every if all(k < 0 or k == v for k, v in zip(y[0], z))]
        return np.log(sum(np.exp(value(z)) for z in fitting) / sum(np.exp(value(z)) for z in every))

    w, moves = rng.normal(size=4), rng.normal(size=(2, 2))
    gw, gm = line_crf._gradient(x, live, y, w, moves)
    for k in range(4):
        step = np.eye(4)[k] * 1e-5
        assert abs((likelihood(w + step, moves) - likelihood(w - step, moves)) / 2e-5 - gw[k]) < 1e-5
    for a in range(2):
        for b in range(2):
            step = np.zeros((2, 2))
            step[a, b] = 1e-5
            assert abs((likelihood(w, moves + step) - likelihood(w, moves - step)) / 2e-5 - gm[a, b]) < 1e-5


#: Menu and notice lines that are not among the lines that boilerplate for fitting is made from.
UNSEEN_MENU = ["Privacy policy", "Accept all cookies", "News", "Latest headlines", "Download app", "Your basket", "Help centre", "Products"]


@pytest.mark.parametrize("place", ["after", "before", "between", "symbols between"])
def test_menu_lines_are_found_and_sentences_kept(docs, labels, texts, place):
    weights, moves = line_crf.train(docs, labels)
    rng = random.Random(3)
    found = lost = unseen = sentences = 0
    for r in labels.filter("quality = 1").orderBy("doc_id").collect():
        lines = [x for x in texts.get(r["doc_id"], "").split("\n") if len(x.split()) >= 5 and x.rstrip().endswith(".")]
        lines = list(dict.fromkeys(lines))
        menu = rng.sample(UNSEEN_MENU, 6)
        if place == "after":
            rows = [(x, True) for x in lines] + [(x, False) for x in menu]
        elif place == "before":
            rows = [(x, False) for x in menu] + [(x, True) for x in lines]
        else:
            other = [f"thoner$$$ to%%% ththwh$$$ oue### {i}" for i in range(6)] if "symbols" in place else menu
            rows = [row for x in lines for row in ((x, True), (rng.choice(other) + (f" {len(x)}" if "symbols" in place else ""), False))]
        scores = line_crf.line_features(signals.Signals(["\n".join(x for x, _ in rows)])) @ weights
        copies = {x for i, (x, _) in enumerate(rows) if x in {z for z, _ in rows[:i]}}
        for (x, content), label in zip(rows, line_crf.decode(scores, moves)):
            if content:
                sentences, lost = sentences + 1, lost + (not label)
            elif x not in copies:
                unseen, found = unseen + 1, found + (not label)
    assert sentences > 100 and unseen > 20
    assert found >= 0.95 * unseen and lost <= 0.05 * sentences


def test_open_lines():
    s = signals.Signals(["Home\nA sentence.\n\nSaid “so.”\nweiß\n这是。\n 12 \t\n***", None, "x"])
    assert line_crf.open_ended(s).tolist() == [True, False, False, False, True, False, True, False, False, True]
