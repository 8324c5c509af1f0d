"""The ten operators against brute force, and their cases: nulls, empty and long texts, ties, repeated rows, empty tables, clashing names."""

import itertools
import pickle
import random
import re

import numpy as np
import pyarrow as pa
import pytest

from scriven.llm import bpe, decontaminate, html_text, huffman, language_id, licenses, media, near_duplicates, quality, recurrent_lm
from scriven.llm import textcore as tc
from tests.conftest import SF

DOCS = "doc_id long, text string, lang string, source string, n_chars long"
#: Names that the operators use themselves.
CLASH = "doc_id long, text string, lang string, __gone string, key string, ids string, language string, accepted string, label string, n string"


def rows(spark, texts, first=0):
    return spark.createDataFrame([(i, t, "en", "s", len(t or "")) for i, t in enumerate(texts, first)], DOCS)


def clashing(spark, texts):
    return spark.createDataFrame([(i, t, "en", "a", "b", "c", "d", "e", "f", "g") for i, t in enumerate(texts)], CLASH)


def words_of(text):
    return re.findall(r"[^\W_]+", (text or "").lower())


def prose(rng, n, vocabulary=4000):
    return " ".join(f"w{rng.randrange(vocabulary)}" for _ in range(n))


# ---------------------------------------------------------------- 7: n-gram Jaccard join


def grams(text, n=3):
    w = words_of(text)
    return frozenset(tuple(w[i : i + n]) for i in range(len(w) - n + 1)) if len(w) >= n else frozenset([tuple(w)] if w else [])


def brute_pairs(texts, threshold=0.5):
    g = [grams(t) for t in texts]
    return {(i, j) for i, j in itertools.combinations(range(len(texts)), 2) if g[i] and g[j] and len(g[i] & g[j]) / len(g[i] | g[j]) >= threshold}


def joined(df):
    return {(r.doc_id_a, r.doc_id_b) for r in df.collect()}


def brute_links(ids, texts, threshold=0.5):
    """Rows of jaccard_links, from all pairs of distinct sets."""
    members = {}
    for i, t in zip(ids, texts):
        if i is not None and grams(t):
            members.setdefault(grams(t), set()).add(i)
    out = set()
    for g, own in members.items():
        links = sum(len(x) for h, x in members.items() if h != g and len(g & h) / len(g | h) >= threshold)
        out |= {(i, min(own), len(own), links) for i in own if len(own) > 1 or links}
    return out


@pytest.fixture(scope="module")
def near():
    rng = random.Random(5)
    base = [prose(rng, 80) for _ in range(30)]
    out = list(base)
    for t in base[:12]:
        for changes in (1, 3, 6, 14):
            w = t.split()
            for _ in range(changes):
                w[rng.randrange(len(w))] = "changed"
            out.append(" ".join(w))
    return [*out, base[0], base[0].upper(), "one two", "One, two!", "single", None, "", " ...", prose(rng, 40_000)]


def test_join_against_brute_force(spark, near):
    want, got = brute_pairs(near), joined(near_duplicates.jaccard_join(rows(spark, near)))
    first = {}
    for i, t in enumerate(near):
        first.setdefault(grams(t), i)
    assert got == {(i, j) for i, j in want if first[grams(near[i])] == i and first[grams(near[j])] == j and grams(near[i]) != grams(near[j])}


def test_links_against_brute_force(spark, near):
    ids = [*range(len(near)), None, 3, 3, 4]
    texts = [*near, near[0], near[3], near[7], near[4]]
    df = spark.createDataFrame(list(zip(ids, texts, texts)), "doc_id long, text string, key string")
    want = brute_links(ids, texts)
    for block in (512, 4):
        got = [tuple(r) for r in near_duplicates.jaccard_links(df, block=block).collect()]
        assert len(got) == len(set(got)) and set(got) == want
    assert near_duplicates.jaccard_links(df.limit(0)).count() == near_duplicates.jaccard_join(df.limit(0)).count() == 0


def test_one_hot_band_in_many_blocks(spark):
    """300 near copies of one document: each of their pairs is found, whatever the blocks."""
    rng = random.Random(6)
    base = prose(rng, 60).split()
    texts = [" ".join(base[:k] + [f"x{i}"] + base[k:]) for i in range(300) for k in [rng.randrange(60)]]
    got = {r.doc_id: r.n_links for r in near_duplicates.jaccard_links(rows(spark, texts), block=16).collect()}
    assert got == {i: 299 for i in range(300)} and joined(near_duplicates.jaccard_join(rows(spark, texts), block=50)) == set(itertools.combinations(range(300), 2))
    assert [r.doc_id for r in near_duplicates.deduplicate(rows(spark, texts), block=16).collect()] == [0]


def test_bands_reach_the_recall():
    bands, r = near_duplicates.bands_for(0.5, 0.95)
    assert 1 - (1 - 0.5**r) ** bands >= 0.95 > 1 - (1 - 0.5**r) ** (bands - 1)


def test_deduplicate_keeps_one_of_each_group(spark, near):
    df = clashing(spark, near)
    kept = near_duplicates.deduplicate(df)
    assert kept.columns == df.columns
    ids = {r.doc_id for r in kept.collect()}
    assert 0 in ids and not ids & {78, 79}
    pairs = brute_pairs(near)
    assert not [p for p in pairs if p[0] in ids and p[1] in ids]
    alone = set(range(len(near))) - {x for p in pairs for x in p}
    assert alone <= ids


def test_deduplicate_null_and_repeated_ids(spark):
    df = spark.createDataFrame([(None, "a b c d"), (1, "a b c d"), (1, "a b c d"), (2, "a b c d"), (None, "a b c d")], "doc_id long, text string")
    assert sorted([r.doc_id for r in near_duplicates.deduplicate(df).collect()], key=str) == [1, 1, None, None]


# ---------------------------------------------------------------- 9: decontamination


def longest_run(doc, item):
    """(words, place in document, place in item) of the longest run, first in the document, then in the item."""
    best = (0, 0, 0)
    at = {}
    for j, w in enumerate(item):
        at.setdefault(w, []).append(j)
    for i, w in enumerate(doc):
        for j in at.get(w, ()):
            if i and j and doc[i - 1] == item[j - 1]:
                continue
            k = 0
            while i + k < len(doc) and j + k < len(item) and doc[i + k] == item[j + k]:
                k += 1
            if k > best[0]:
                best = (k, i, j)
    return best


@pytest.fixture(scope="module")
def leaked():
    rng = random.Random(9)
    items = [prose(rng, n, 300) for n in (30, 12, 9, 5, 3)] + ["", None]
    docs = [prose(rng, 120, 300) for _ in range(40)]
    for i, d in enumerate(docs[:25]):
        w, item = d.split(), items[i % 5].split()
        size = min(len(item), rng.choice([4, 7, 8, 9, 30]))
        a, at = rng.randrange(len(item) - size + 1), rng.randrange(len(w))
        w[at:at] = item[a : a + size]
        docs[i] = " ".join(w)
    docs.append(docs[0] + " " + items[0] + " x " + items[0])
    return [*docs, None, "", items[3], prose(rng, 30_000, 300) + " " + items[1]], items


def test_matches_against_brute_force(spark, leaked):
    docs, items = leaked
    want = set()
    for (i, d), (j, b) in itertools.product(enumerate(docs), enumerate(items)):
        k, p, q = longest_run(words_of(d), words_of(b))
        if words_of(b) and k >= min(8, len(words_of(b))):
            want.add((i, j, k, p, q))
    bench = spark.createDataFrame(list(enumerate(items)), "item_id long, text string")
    for shard in (1 << 20, 300):
        assert {tuple(r) for r in decontaminate.matches(rows(spark, docs), bench, shard=shard).collect()} == want
    kept = decontaminate.decontaminate(clashing(spark, docs), bench)
    assert {r.doc_id for r in kept.collect()} == set(range(len(docs))) - {w[0] for w in want}


def test_nothing_to_decontaminate(spark):
    none = spark.createDataFrame([], "item_id long, text string")
    assert decontaminate.decontaminate(rows(spark, ["a b"]), none).count() == 1
    assert decontaminate.matches(rows(spark, []), none).count() == 0


def test_suffix_array_is_sorted():
    rng = np.random.default_rng(3)
    words = rng.integers(1, 4, 300).astype(np.uint64) << np.uint64(40)
    bound = np.array([0, 100, 100, 300])
    seq, order = decontaminate.suffix_array(words, bound)

    def suffix(p):
        end = p
        while seq[end]:
            end += 1
        return seq[p:end].tolist()

    got = [suffix(p) for p in order]
    assert got == sorted(got) and len(got) == 300


# ---------------------------------------------------------------- 5 and 2: classifiers

EN = "the house is by the river and people walk there in the evening when it is warm".split()
FR = "la maison est près de la rivière et les gens marchent ici le soir quand il fait chaud".split()


def two_languages(n, rng):
    return [(" ".join(rng.choice(v) for _ in range(60)), name) for name, v in (("en", EN), ("fr", FR)) for _ in range(n)]


def test_language_on_held_out_documents(spark):
    rng = random.Random(2)
    train = spark.createDataFrame([(i, t, k) for i, (t, k) in enumerate(two_languages(60, rng))], "doc_id long, text string, lang string")
    filters = language_id.fit(train)
    held = two_languages(20, rng) + [(None, "und"), ("", "und"), ("123 456", "und"), ("Ωμέγα ψωμί καλημέρα " * 20, "und"), (" ".join(EN) * 20_000, "en")]
    df = spark.createDataFrame([(i, t, k, "x") for i, (t, k) in enumerate(held)], "doc_id long, text string, lang string, language string")
    got = {r.doc_id: r.language for r in language_id.identify(df, filters).collect()}
    assert [got[i] for i in range(len(held))] == [k for _, k in held]
    kept = language_id.accept(df, filters)
    assert kept.columns == df.columns and {r.doc_id for r in kept.collect()} == {i for i, (_, k) in enumerate(held) if k != "und"}


def test_filters_return_every_language_and_few_others():
    g = np.random.default_rng(1)
    sets = {k: g.integers(0, 1 << 63, 5000).astype(np.uint64) for k in "abc"}
    sets["b"][:100] = sets["a"][:100]
    f = language_id.build(sets)
    for bit, k in enumerate(f.languages):
        assert ((f.lookup(sets[k]) >> bit) & 1).all()
    strange = f.lookup(g.integers(0, 1 << 63, 20_000).astype(np.uint64))
    assert all(abs(((strange >> b) & 1).mean() - f.false_positive[b]) < 0.01 for b in range(3))


def test_language_scores_against_brute_force():
    """Corrected hits from sets of n-grams, of more than 64 languages: filters may only add false positives, which are corrected."""
    rng = random.Random(12)
    texts = {f"l{k:03d}": [" ".join("".join(rng.choice("abcdefghijklmnop") for _ in range(5)) for _ in range(60))] for k in range(70)}
    f = language_id.build(language_id.learn(texts, rate=0))
    assert len(f.languages) == 70 and len(f.masks) == 2
    seen = {}
    for name, (text,) in texts.items():
        every = [g for n in (4, 3) for w in text.split() for p in [f" {w} "] for g in (p[i : i + n] for i in range(len(p) - n + 1))]
        seen[name] = {g for g in every if every.count(g) >= 2}, every
    held = [texts["l069"][0], texts["l003"][0] + " zzzz", "zz", None, "", texts["l069"][0]]
    n, hits = language_id.score(f, held)
    for i, t in enumerate(held):
        every = [g for k in (4, 3) for w in (t or "").split() for p in [f" {w} "] for g in (p[j : j + k] for j in range(len(p) - k + 1))]
        assert n[i] == len(every)
        for b, name in enumerate(f.languages):
            exact = sum(g in seen[name][0] for g in every)
            fp = f.false_positive[b]
            assert abs(hits[i, b] * (1 - fp) + n[i] * fp - exact) <= 2
    assert (hits[0] == hits[5]).all()


def test_language_cases(spark):
    rng = random.Random(3)
    train = spark.createDataFrame([(i, t, k) for i, (t, k) in enumerate(two_languages(40, rng))], "doc_id long, text string, lang string")
    df = spark.createDataFrame([(None, " ".join(EN) * 3), (1, " ".join(FR) * 3), (1, " ".join(FR) * 3)], "doc_id long, text string")
    assert sorted((str(r.doc_id), r.language) for r in language_id.identify(df, language_id.fit(train)).collect()) == [("1", "fr"), ("1", "fr"), ("None", "en")]


def test_language_without_labels(spark):
    df = spark.createDataFrame([(1, "some text", None)], "doc_id long, text string, lang string")
    f = language_id.fit(df)
    assert language_id.identify(df, f).first().accepted is False
    assert language_id.accept(df.limit(0), f).count() == 0


def test_quality_on_held_out_documents(spark):
    """Every fourth labelled document of sf0.1 is held out; 12 % are toxic, many by one word among thousands."""
    at = SF.parent / "sf0.1"
    docs, labels = spark.read.parquet(str(at / "documents.parquet")), spark.read.parquet(str(at / "labels.parquet"))
    held = labels.where("doc_id % 4 = 0")
    model = quality.fit(docs, labels.where("doc_id % 4 <> 0"))
    got = quality.classify(docs.join(held, "doc_id", "left_semi"), model).join(held, "doc_id").toPandas()
    low, toxic = got.quality == 0, got.toxic == 1
    assert len(got) > 500
    assert ((got.p_low_quality >= 0.5) == low).mean() >= 0.95
    assert ((got.p_toxic >= 0.5) == toxic).mean() >= 0.95
    assert (~got.accepted[toxic]).mean() >= 0.8 and got.accepted[~toxic & ~low].mean() >= 0.98


def test_quality_cases(spark):
    docs = rows(spark, ["good clean text", "bad junk text", None, "", "word " * 60_000])
    labels = spark.createDataFrame([(0, 1, 0), (1, 0, 1), (1, 0, None), (None, 1, 1), (7, None, None)], "doc_id long, quality int, toxic int")
    model = quality.fit(docs, labels)
    got = {r.doc_id: r for r in quality.classify(docs, model).collect()}
    assert got[2].p_toxic is None and not got[2].accepted and not got[3].accepted and got[4].p_toxic is not None
    df = clashing(spark, ["good clean text", None])
    assert quality.accept(df, model).columns == df.columns
    free = quality.fit(docs, labels.limit(0))
    assert {r.doc_id for r in quality.accept(docs, free).collect()} == {0, 1, 4}
    assert quality.accept(docs.limit(0), model).count() == 0


# ---------------------------------------------------------------- 10 and 3: tokens


def test_bpe_is_that_of_another_library(spark):
    import base64

    import tiktoken

    ranks = {base64.b64decode(a): int(b) for a, b in (x.split() for x in open(bpe.VOCABULARY, "rb") if x.strip())}
    other = tiktoken.Encoding("x", pat_str=bpe.PATTERN, mergeable_ranks=ranks, special_tokens={})
    rng = random.Random(4)
    alphabet = "abcdefgh eéß的 \n\t  .,!?'s12345😀"
    texts = ["", " ", "  a", "a  ", "it's  the\n\nend ", "x" * 3000, "ab" * 2000, "<|endoftext|>", "a" + " " * 500 + "b"]
    texts += ["".join(rng.choice(alphabet) for _ in range(rng.randrange(1, 300))) for _ in range(300)] + [prose(rng, 60_000)]
    df = rows(spark, [*texts, None])
    got = {r.doc_id: r for r in bpe.encode(df, bpe.load()).collect()}
    for i, t in enumerate(texts):
        assert got[i].token_ids == other.encode_ordinary(t), t[:50]
        assert got[i].round_trip and got[i].n_tokens == len(got[i].token_ids)
    assert got[len(texts)].token_ids is None and got[len(texts)].n_tokens is None
    back = {r.doc_id: r.text for r in bpe.decode(bpe.encode(df, bpe.load()), bpe.load()).collect()}
    assert [back[i] for i in range(len(texts))] == texts and back[len(texts)] is None
    assert bpe.encode(df.limit(0), bpe.load()).count() == 0


def test_bpe_cuts_are_those_of_the_pattern():
    rng = random.Random(7)
    alphabet = "abé的 \n\t\xa0\x1c\u3000.,!''sledrvtmSLED123٣😀"
    texts = ["", "'", "it's", "we'll've 'd x'sa ''s  's\n's", "'re", "x'r", "'s'", "a's's"] + ["".join(rng.choice(alphabet) for _ in range(rng.randrange(60))) for _ in range(3000)]
    raw, begin, first = bpe._cut(texts)
    got = [raw[a:z].decode() for a, z in zip(begin, begin[1:])]
    find = bpe.regex.compile(bpe.PATTERN).findall
    assert [got[a:z] for a, z in zip(first, first[1:])] == [find(t) for t in texts]


def test_bpe_encodes_together_as_alone():
    """Small vocabularies with many dead ends: all pieces together, each alone, and merging by rank."""
    rng = random.Random(8)
    for _ in range(12):
        tokens = [bytes([i]) for i in range(256)]
        while len(tokens) < 300:
            t = rng.choice(tokens[97:100] + tokens[256:]) + rng.choice(tokens[97:100] + tokens[256:])
            if t not in tokens and (len(t) == 2 or bpe._merge_of(t, {x: i for i, x in enumerate([*tokens, t])})):
                tokens.append(t)
        vocab = bpe.vocabulary(tokens)
        ranks = {t: i for i, t in enumerate(tokens)}
        assert vocab.split.min() >= 0

        def merged(data):
            parts = [data[i : i + 1] for i in range(len(data))]
            while len(parts) > 1:
                r, i = min((ranks.get(parts[i] + parts[i + 1], 1 << 30), i) for i in range(len(parts) - 1))
                if r == 1 << 30:
                    break
                parts[i : i + 2] = [parts[i] + parts[i + 1]]
            return [ranks[p] for p in parts]

        data = [bytes(rng.choice(b"abc") for _ in range(rng.randrange(1, 40))) for _ in range(150)]
        ids, at = vocab.encoder.pieces(np.frombuffer(b"".join(data), np.uint8), np.concatenate(([0], np.cumsum([len(d) for d in data]))))
        for d, a, z in zip(data, at, at[1:]):
            assert ids[a:z].tolist() == merged(d) == vocab.encoder.piece(d)


def test_bpe_cases(spark):
    df = spark.createDataFrame([(None, "same text", "x", 1), (3, "same text", "x", 1), (3, "same text", "x", 1), (4, None, "x", 1), (5, "", "x", 1)], "doc_id long, text string, token_ids string, n_tokens long")
    got = bpe.encode(df, bpe.load()).collect()
    same = [tuple(r.token_ids) for r in got if r.token_ids]
    assert len(got) == 5 and len(same) == 3 and len(set(same)) == 1 and sorted(str(r.doc_id) for r in got) == ["3", "3", "4", "5", "None"]
    assert [r.token_ids for r in got if r.doc_id == 5] == [[]] and [r.round_trip for r in got if r.doc_id == 4] == [None]
    other = bpe.vocabulary([bytes([i]) for i in range(256)], r"\w+|\W+")
    assert [r.token_ids for r in bpe.encode(df.where("doc_id = 3"), other).collect()] == [list(b"same text")] * 2


def test_huffman_cases(spark):
    df = spark.createDataFrame([(None, [3, 3, 5]), (1, [3, 3, 5]), (1, [3, 3, 5]), (2, [])], "doc_id long, token_ids array<int>")
    got = huffman.encode(df, huffman.fit(df)).collect()
    assert len({bytes(r.payload) for r in got if r.n_ids}) == 1 and all(r.round_trip for r in got) and len(got) == 4
    with pytest.raises(Exception, match="negative id"):
        huffman.fit(df.selectExpr("doc_id", "array(-1) token_ids"))


def test_huffman_lengths_at_a_binding_limit():
    """Every choice of lengths that obeys the limit and Kraft's inequality, tried out."""
    rng = random.Random(9)
    for _ in range(30):
        n, limit = rng.randrange(3, 7), 3
        counts = np.array([rng.choice([1, 1, 2, 3, 50, 1000]) for _ in range(n)])
        best = min(sum(c * x for c, x in zip(counts, lengths)) for lengths in itertools.product(range(1, limit + 1), repeat=n) if sum(2.0**-x for x in lengths) <= 1)
        got = huffman.code_lengths(counts, limit)
        assert got.max() <= limit and (2.0**-got).sum() <= 1 and (got * counts).sum() == best


def test_huffman_round_trip_and_optimum(spark, tmp_path):
    rng = np.random.default_rng(8)
    lists = [rng.zipf(1.4, n).clip(max=3000).tolist() for n in (0, 1, 255, 256, 257, 5000)] + [None, [7]]
    df = spark.createDataFrame([(i, x, "y") for i, x in enumerate(lists)], "doc_id long, token_ids array<int>, payload string")
    huffman.write(df, str(tmp_path / "h"))
    assert {r.doc_id: r.token_ids for r in huffman.read(spark, str(tmp_path / "h")).collect()} == dict(enumerate(lists))
    code = huffman.fit(df)
    assert code.length.max() <= huffman.LONGEST and (2.0 ** -code.length).sum() <= 1
    coded = {r.doc_id: r for r in huffman.encode(df, code).collect()}
    assert all(coded[i].round_trip for i in range(6)) and coded[6].payload is None and len(coded[5].checkpoints) == 20
    # lengths are those of an unlimited Huffman code where that is short enough
    import heapq

    counts = np.array([5, 9, 12, 13, 16, 45])
    heap = [(int(c), k, [k]) for k, c in enumerate(counts)]
    depth = [0] * 6
    heapq.heapify(heap)
    while len(heap) > 1:
        a, b = heapq.heappop(heap), heapq.heappop(heap)
        for k in a[2] + b[2]:
            depth[k] += 1
        heapq.heappush(heap, (a[0] + b[0], min(a[1], b[1]), a[2] + b[2]))
    assert (huffman.code_lengths(counts) * counts).sum() == (np.array(depth) * counts).sum()
    assert huffman.fit(df.limit(0)).ids.tolist() == [] and huffman.encode(df.limit(0), code).count() == 0


# ---------------------------------------------------------------- 1, 4, 6, 8


def test_licenses_against_brute_force(spark):
    rng = random.Random(6)
    texts = [prose(rng, 60)]
    for name, t in licenses.TEMPLATES.items():
        w = t.split()
        for drop in (0, 1, 2, 5):
            own = list(w)
            for _ in range(drop):
                own.insert(rng.randrange(len(own)), "extra")
            texts.append(prose(rng, rng.randrange(50)) + " " + " ".join(own) + " " + prose(rng, 30))
    texts += [licenses.TEMPLATES["mit-notice"] * 2, None, "", "two words", prose(rng, 30_000) + " " + licenses.TEMPLATES["gpl-3.0-header"]]

    def brute(text, template):
        d, t = words_of(text), words_of(template)
        want = {tuple(t[i : i + 3]) for i in range(len(t) - 2)}
        g = [tuple(d[i : i + 3]) for i in range(len(d) - 2)]
        hits = [i for i, x in enumerate(g) if x in want]
        best = max(((len({g[k] for k in hits if i <= k < i + len(t) - 2}), -i) for i in hits), default=(0, 0))
        return round(best[0] / len(want), 6), -best[1]

    want = {(i, name, *brute(t, tpl)) for i, t in enumerate(texts) for name, tpl in licenses.TEMPLATES.items() if brute(t, tpl)[0] >= licenses.CONTAINMENT}
    assert {tuple(r) for r in licenses.scan(clashing(spark, texts)).collect()} == want
    assert licenses.scan(rows(spark, [])).count() == 0


def test_html_cases(spark):
    body = "This is a sentence of the article that is long enough to count as running text here and now."
    page = f"<html><head><title>T</title><style>x{{}}</style></head><body><nav><a>Home</a></nav><article><p>{body}</p><p>{body} &amp; more</p></article><footer>Imprint</footer><script>var a='<p>no</p>'</script></body></html>"
    texts = [page, None, "", "plain", "<p>unclosed <!-- rest", "<div>" * 20_000 + body]
    df = spark.createDataFrame([(i, "u", t, "x") for i, t in enumerate(texts)], "page_id long, url string, html string, text string")
    got = {r.page_id: r for r in html_text.extract(df).collect()}
    assert got[0].text == f"{body}\n{body} & more" and got[0].n_lines == 2
    assert got[1].text is None and got[1].n_lines is None and got[2].text == "" and got[2].surge_line is None
    assert got[3].text == "plain" and got[4].text == "unclosed" and body in got[5].text
    assert html_text.extract(df.limit(0)).count() == 0


def test_kept_lines_against_brute_force():
    rng = random.Random(1)
    for _ in range(200):
        n = [rng.choice([0, 0, 5, 40, 90]) for _ in range(rng.randrange(1, 15))]
        block = [sum(n[i : i + 3]) for i in range(len(n))]
        inside, want = False, []
        for b in block:
            inside = (b > 0 and b >= min(86, max(block))) or (inside and b > 0)
            want.append(inside)
        assert html_text.kept(np.array(n), np.array([0, len(n)])).tolist() == want


def test_gradients_by_differences():
    g = np.random.default_rng(2)
    hashes = np.sort(g.integers(1, 1 << 60, 30).astype(np.uint64))
    model = recurrent_lm.fresh(hashes, np.array([0, 3, 4, 14, 32]), width=5)
    p = {k: v.astype(np.float64) for k, v in model.params.items()}
    windows = list(recurrent_lm._windows([g.integers(0, 30, 9), g.integers(0, 30, 4)], lanes=2))
    h = np.zeros((5, 2))
    _, grads, _ = recurrent_lm.gradients(model, p, h, windows[0])
    dense = np.zeros_like(p["embed"])
    dense[grads["embed"][0]] = grads["embed"][1]
    grads["embed"] = dense
    for name in recurrent_lm.NAMES:
        flat = p[name].reshape(-1)
        k = int(np.argmax(np.abs(grads[name].reshape(-1))))
        keep, eps = flat[k], 1e-5
        flat[k] = keep + eps
        up = recurrent_lm.gradients(model, p, h, windows[0])[0]
        flat[k] = keep - eps
        down = recurrent_lm.gradients(model, p, h, windows[0])[0]
        flat[k] = keep
        assert abs((up - down) / (2 * eps) - grads[name].reshape(-1)[k]) <= 2e-2 * max(1, abs(grads[name].reshape(-1)[k])), name


def test_likelihood_against_brute_force():
    """Word by word, with the whole vocabulary's probabilities: they are a distribution and give the documents' likelihoods."""
    g = np.random.default_rng(5)
    n = np.sort(g.integers(1, 400, 28))[::-1]
    model = recurrent_lm.fresh(np.sort(g.integers(1, 1 << 60, 28).astype(np.uint64)), recurrent_lm.class_bounds(np.concatenate(([1, 50], n))), width=6)
    assert len(model.first) > 3 and model.first[-1] == 30
    model.params["word_out"][:, -1] = g.normal(size=30)
    p = {k: v.astype(np.float64) for k, v in model.params.items()}
    sigmoid = lambda v: 1 / (1 + np.exp(-v))

    def softmax(v):
        return np.exp(v - v.max()) / np.exp(v - v.max()).sum()

    def probabilities(h):
        out, classes = np.zeros(30), softmax(p["class_out"] @ np.append(h, 1))
        for c, (a, z) in enumerate(zip(model.first, model.first[1:])):
            out[a:z] = classes[c] * softmax(p["word_out"][a:z] @ np.append(h, 1))
        assert abs(out.sum() - 1) < 1e-9
        return out

    docs, want = [g.integers(1, 30, k) for k in (0, 1, 40, 7, 700, 16)], []
    for d in docs:
        h, last, total = np.zeros(6), recurrent_lm.END, 0.0
        for word in [*d.tolist(), recurrent_lm.END]:
            x, a = p["embed"][last] @ p["gate_in"] + p["gate_bias"], h @ p["gate_state"]
            z, r = sigmoid(x[:6] + a[:6]), sigmoid(x[6:12] + a[6:12])
            new = np.tanh(x[12:] + r * a[12:])
            h, last = z * h + (1 - z) * new, word
            total += np.log(probabilities(h)[word])
        want.append(total)
    assert np.allclose(recurrent_lm.log_likelihoods(model, docs), want, rtol=1e-4)


def test_language_model_cases(spark):
    df = spark.createDataFrame([(None, "one two three", "x"), (1, "one two three", "x"), (1, "one two three", "x"), (2, None, "x")], "doc_id long, text string, n_words string")
    got = recurrent_lm.score(df, recurrent_lm.fit(df)).collect()
    assert len(got) == 4 and len({round(r.log_likelihood, 3) for r in got if r.log_likelihood}) == 1 and sorted(str(r.doc_id) for r in got) == ["1", "1", "2", "None"]


def test_language_model_learns_and_carries_state(spark):
    rng = random.Random(3)
    cycle = "alpha beta gamma delta epsilon".split()
    regular = [" ".join(cycle[(s + i) % 5] for i in range(80)) for s in range(5)] * 40
    df = rows(spark, [*regular, None, "", "omega " * 50_000])
    model = recurrent_lm.fit(df)
    test = rows(spark, [regular[0], " ".join(rng.choice(cycle) for _ in range(80)), None, ""])
    got = {r.doc_id: r for r in recurrent_lm.score(test, model).collect()}
    assert got[0].log_likelihood > got[1].log_likelihood
    assert got[2].log_likelihood is None and got[3].n_words == 0 and got[3].log_likelihood < 0
    # each document scored alone gives what it gives among others
    alone = recurrent_lm.score(test.where("doc_id = 1"), model).first()
    assert abs(alone.log_likelihood - got[1].log_likelihood) < 1e-2
    assert recurrent_lm.score(test.limit(0), model).count() == 0
    assert recurrent_lm.score(test, recurrent_lm.fit(test.limit(0))).count() == 4


def test_language_model_vocabulary_grows_and_rare_words_are_spelled(spark):
    rng = random.Random(5)
    small, large = (rows(spark, [prose(rng, 400) for _ in range(n)]) for n in (20, 500))
    sizes = [len(recurrent_lm.vocabulary(df)[0]) for df in (small, large)]
    assert sizes[0] < sizes[1] > 2046
    model = recurrent_lm.fit(small)
    got = [r.log_likelihood for r in recurrent_lm.score(rows(spark, ["w1 w31311", "w1 w31312 ", "w1 \u0436\u0444", "w1 zq\u0436\u0444yx"]), model).orderBy("doc_id").collect()]
    assert got[0] > got[2] > got[3] and got[1] > got[3]
    # letters' probabilities are a distribution, after seen and unseen letters
    letters = np.append(0, np.flatnonzero(tc._tables()[0]))
    for a, b in (("w", "1"), ("\0", "w"), ("\0", "\0"), ("\u0436", "1"), ("w", "\u0444")):
        assert abs(model.spelling.probability((ord(a) << 42) | (ord(b) << 21) | letters).sum() - 1) < 1e-9


def test_language_model_trains_on_whole_documents():
    g = np.random.default_rng(4)
    docs = [g.integers(2, 40, n) for n in (0, 3, 700, 15, 16, 17, 1, 40, 5000, 2)]
    read, lane_of, place = {}, {}, np.arange(3)
    for lanes, x in recurrent_lm._refilled(iter(docs), lanes=3):
        place = place[lanes]
        for k in range(x.source.shape[1]):
            for t in np.flatnonzero(x.valid[:, k]):
                d = int(x.doc[t, k])
                assert lane_of.setdefault(d, place[k]) == place[k]
                assert x.source[t, k] == (read[d][-1] if d in read else recurrent_lm.END)
                assert (x.go_on[t, k] == 0) == (d not in read)
                read.setdefault(d, []).append(int(x.target[t, k]))
    assert [read[d] for d in range(len(docs))] == [[*x.tolist(), recurrent_lm.END] for x in docs]
    # what is learned doesn't depend on batches: one of all documents, and one for each
    model = recurrent_lm.fresh(np.sort(g.integers(1, 1 << 60, 38).astype(np.uint64)), width=5)
    (one, n), (each, m) = recurrent_lm.train(model, iter([docs])), recurrent_lm.train(model, iter([x] for x in docs))
    assert n == m == sum(map(len, docs)) + len(docs)
    assert all(np.array_equal(one[k], each[k]) for k in recurrent_lm.NAMES)


def test_language_model_steps_in_blocks(monkeypatch):
    """Blocks of steps, parts of a class and the scale change no gradient; the bounds on outputs aren't computed anew each window and hold."""
    g = np.random.default_rng(9)
    model = recurrent_lm.fresh(np.sort(g.integers(1, 1 << 60, 38).astype(np.uint64)), np.array([0, 1, 2, 12, 40]), width=5)
    docs = [g.integers(1, 40, n) for n in (3, 40, 12, 1, 0, 25)]
    p, got = {k: v.astype(np.float64) for k, v in model.params.items()}, []
    for slab, rows, scale in ((512, 1024, 1.0), (1, 4, 1.0), (7, 3, 0.25)):
        monkeypatch.setattr(recurrent_lm, "SLAB", slab)
        monkeypatch.setattr(recurrent_lm, "ROWS", rows)
        h, out = np.zeros((5, 3)), []
        for lanes, x in recurrent_lm._refilled(iter(docs), lanes=3):
            loss, grads, h = recurrent_lm.gradients(model, p, h[:, lanes], x, scale)
            grads["embed_rows"], grads["embed"] = grads["embed"]
            out += [np.array(loss), h, *(grads[k] / (1 if k == "embed_rows" else scale) for k in sorted(grads))]
        got.append((out, recurrent_lm.log_likelihoods(model, docs)))
    for out, each in got[1:]:
        assert len(out) == len(got[0][0]) and all(np.allclose(a, b, rtol=1e-9, atol=1e-12) for a, b in zip(out, got[0][0]))
        assert np.allclose(each, got[0][1], rtol=1e-5)
    monkeypatch.undo()
    model.params["word_out"][5] *= 40  # near to what exp takes, and soon beyond it
    bounds, step, counted, windows = recurrent_lm._all_wide, recurrent_lm.gradients, [], []

    def watched(model, p, h, x, scale=1.0, wide=None):
        for now, used in zip(bounds(model, p)[0], wide):
            assert all(u or not n for n, u in zip(now, used))
        windows.append(1)
        return step(model, p, h, x, scale, wide)

    monkeypatch.setattr(recurrent_lm, "_all_wide", lambda *a: counted.append(1) or bounds(*a))
    monkeypatch.setattr(recurrent_lm, "gradients", watched)
    for k in (1, 3):
        model.params["word_out"][5] *= k
        counted.clear(), windows.clear()
        recurrent_lm.train(model, iter([[g.integers(1, 40, 20) for _ in range(3000)] + [np.full(4000, 5)]]))
        assert len(windows) > 20 and (len(counted) < len(windows) / 2 if k == 1 else len(counted) == len(windows))


def test_language_model_spells_every_letter():
    texts = ["Abc x", "", None, "abd \U00020000"]
    words = tc.Words(texts, spans=True)
    keys, owner = recurrent_lm._letters(words, np.arange(4))
    want = [tuple(map(ord, t)) for w in words_of("abc x abd \U00020000") for t in zip("\0\0" + w, "\0" + w, w + "\0")]
    assert [(k >> 42, k >> 21 & 0x1FFFFF, k & 0x1FFFFF) for k in keys.tolist()] == want
    assert owner.tolist() == [0] * 4 + [1] * 2 + [2] * 4 + [3] * 2


def test_huffman_bits_against_strings():
    """Streams of long and short codes, many of them within one word of 32 bits, bit by bit; the packed tables hold each code."""
    g = np.random.default_rng(8)
    for length in ([1], [1, 1], [*range(1, 24), 24, 24], [2, 2, *range(3, 17), 16, 2][:-1]):
        code = huffman.Code(np.arange(len(length)) * 3, np.array(length))
        bits = {i: format(c, f"0{n}b") for i, c, n in zip(code.ids.tolist(), code.code.tolist(), code.length.tolist())}
        assert all(code.by_id[i] == int(b, 2) << 5 | len(b) for i, b in bits.items())
        lists = [g.choice(code.ids, n) for n in (0, 1, 1, 2, 0, 700, 3, 256, 257, 0)]
        bound = np.concatenate(([0], np.cumsum([len(x) for x in lists])))
        data, first, size, marks, blocks = code.encode(np.concatenate(lists), bound, 256)
        for k, x in enumerate(lists):
            want = "".join(bits[i] for i in x.tolist())
            assert size[k] == len(want) and "".join(f"{b:08b}" for b in data[first[k] : first[k + 1]]) == want + "0" * (-len(want) % 8)
            own = marks[blocks[k] : blocks[k + 1]]
            assert code.decode(data, own + first[k] * 8, np.minimum(256, len(x) - 256 * np.arange(len(own)))).tolist() == x.tolist()
        with pytest.raises(ValueError, match="no code"):
            huffman.Code(np.array([0, 2]), np.array([1, 1])).encode(np.array([1]), np.array([0, 1]))


def test_language_model_looks_up_words_and_bounds_tasks(spark):
    g = np.random.default_rng(6)
    for keys in (np.zeros(0, np.int64), np.arange(3000) << 42, np.unique(g.integers(-(1 << 62), 1 << 62, 5000))):
        keys = g.permutation(keys)
        index = pickle.loads(pickle.dumps(recurrent_lm._Index(keys)))
        wanted, place = np.concatenate((keys, keys + 1, [0, -1])), {k: i for i, k in enumerate(keys.tolist())}
        assert index.find(wanted).tolist() == [place.get(k, -1) for k in wanted.tolist()]
    df, cores = spark.range(200).repartition(60), spark.sparkContext.defaultParallelism
    for many in (0, 1, 40, 100):
        assert recurrent_lm.tasks(df, many * recurrent_lm.TASK).rdd.getNumPartitions() == min(60, max(many, cores))


def test_jpeg_and_avi_round_trip():
    g = np.random.default_rng(0)
    picture = np.clip(128 + 60 * np.sin(np.arange(40)[:, None] / 6 + np.arange(50)[None, :] / 9) + g.normal(0, 3, (40, 50)), 0, 255).astype(np.uint8)
    for tables in (False, True):
        assert np.abs(media.decode_luma(media.encode_luma(picture, tables)).astype(int) - picture).mean() < 3
    frames = [media.encode_luma(np.full((16, 16), v, np.uint8)) for v in (20, 20, 200, 200, 200)]
    for index in (True, False):
        seconds, got = media.parse_avi(media.encode_avi(frames, 16, 16, index=index))
        assert got == frames and seconds == pytest.approx(0.04)


def test_avi_of_several_segments():
    frames = [media.encode_luma(np.full((16, 16), v, np.uint8)) for v in (20, 200, 90, 240)]
    more = media._chunk(b"LIST", b"movi" + b"".join(media._chunk(b"00dc", f) for f in frames[2:]))
    for index in (True, False):
        film = media.encode_avi(frames[:2], 16, 16, index=index) + media._chunk(b"RIFF", b"AVIX" + more)
        assert media.parse_avi(film)[1] == frames
        assert [s[:2] for s in media.shots(film)] == [(0, 3)] or len(media.shots(film)) > 1


def test_cuts_against_brute_force():
    import statistics

    rng, reached = np.random.default_rng(4), 0
    for _ in range(300):
        n = int(rng.integers(1, 30))
        hists = rng.dirichlet(np.full(6, rng.choice([0.3, 3, 300])), n)
        hists[n // 2 :] = np.roll(hists[n // 2 :] ** rng.choice([1, 3]), 3, axis=1)
        hists /= hists.sum(axis=1, keepdims=True)
        diff = [sum(abs(x - y) for x, y in zip(a, b)) / 2 for a, b in zip(hists, hists[1:])]
        want = [0]
        for i, d in enumerate(diff):
            around = diff[max(0, i - 4) : i] + diff[i + 1 : i + 5]
            middle = statistics.median(around) if around else 0
            spread = 3 * 1.4826 * statistics.median(abs(x - middle) for x in around) if around else 0
            reached += spread > media.FLOOR
            want += [i + 1] * int(d - middle > max(media.FLOOR, spread) + 1e-12)
        assert media.cuts(hists) == want
    assert reached


def test_flicker_needs_the_adaptive_threshold():
    vector = [0.1, -0.3, 0.2, 0.05, -0.1, 0.4]
    frames = [media.encode_luma(media.picture(1, vector, k, f)) for k in range(3) for f in range(4)]
    assert len(set(frames)) == 12
    hists = np.array([media.histogram(media.decode_luma(f)) for f in frames])
    diff = np.abs(np.diff(hists, axis=0)).sum(axis=1) / 2
    assert (diff >= media.FLOOR).sum() > 2  # a fixed threshold would cut within scenes
    assert media.cuts(hists) == [0, 4, 8]


def test_clips(spark):
    grey = lambda v: media.encode_luma(np.full((16, 16), v, np.uint8))
    film = media.encode_avi([grey(20)] * 3 + [b""] + [grey(200)] * 2 + [b"damaged"] + [grey(90)], 16, 16)
    df = spark.createDataFrame([(1, film, "x"), (1, film, "x"), (None, film, "x"), (2, None, "x"), (3, b"", "x"), (4, film[:300], "x"), (5, b"RIFF....AVI ", "x")], "media_id long, media binary, clip string")
    got = media.clips(df).collect()
    assert [(r.clip, r.first_frame, r.last_frame) for r in got if r.media_id == 1] == [(0, 0, 3), (1, 4, 6), (2, 7, 7)] * 2
    assert len([r for r in got if r.media_id is None]) == 3
    assert {r.media_id for r in got if r.error} == {2, 3, 5} | ({4} if [r for r in got if r.media_id == 4 and r.error] else set())
    assert media.clips(df.limit(0)).count() == 0
    odd = spark.createDataFrame([(1, None), (2, [float("nan")]), (None, [1.0])], "vec_id long, embedding array<float>")
    assert media.clips(media.synthesize(odd)).where("error is null").groupBy("media_id").count().count() == 2


# ---------------------------------------------------------------- shared


def test_word_hashes_do_not_depend_on_cuts():
    text = "añb " * 200_000
    w = tc.Words([text, None, "añb"])
    assert len(set(w.hash.tolist())) == 1 and np.diff(w.bound).tolist() == [200_000, 0, 1]


def test_batches_cover_all_rows():
    batch = pa.RecordBatch.from_pydict({"text": ["x" * n for n in (0, 300_000, 5, 300_000)] + [None]})
    assert [t for _, texts in tc.batches([batch]) for t in texts] == batch.column(0).to_pylist()
