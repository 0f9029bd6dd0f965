"""Substring removal, ranked search and token alignment against plain versions of themselves."""

import collections
import hashlib
import math
import random
import re

import numpy as np
import pytest

from fencewatch.llm import alignment, ranked, substrings
from fencewatch.llm.queries import QUERIES, vocabulary
from tests.llm.cases import DATA, odd_documents, random_text, with_clashes

_WORD = re.compile(r"[^\x20\x09-\x0D]+")
_TERM = re.compile(r"[^\x00-\x2F\x3A-\x40\x5B-\x60\x7B-\x7F]+")


def _sorted(rows):
    return sorted((tuple(r) for r in rows), key=repr)


# --- substrings


def _plain_spans(rows, size):
    first = {}
    for doc_id, text in rows:
        words = _WORD.findall(text or "")
        for i in range(len(words) - size + 1):
            key = tuple(words[i : i + size])
            if doc_id is not None and (key not in first or doc_id < first[key]):
                first[key] = doc_id
    out = []
    for doc_id, text in rows:
        words = _WORD.findall(text or "")
        gone = set()
        for i in range(len(words) - size + 1):
            if doc_id is not None and first[tuple(words[i : i + size])] < doc_id:
                gone |= set(range(i, i + size))
        out.append((doc_id, len(words), len(gone), " ".join(w for i, w in enumerate(words) if i not in gone)))
    return out


def _shared_passages(size):
    """Passages at several places of several texts, some with a word changed, some side by side, some cut short."""
    draw = random.Random(size)
    passages = [random_text(draw, n) for n in (size - 1, size, size + 3, 3 * size) for _ in range(2)]
    line = random_text(draw, size + 2)
    rows = []
    for number in range(60):
        parts = []
        for _ in range(draw.randint(1, 5)):
            words = draw.choice(passages).split()
            if draw.random() < 0.4:
                words[draw.randrange(len(words))] = "changed"
            if draw.random() < 0.3:
                words = words[draw.randint(0, 4) :]
            parts += [" ".join(words), draw.choice(["", random_text(draw, draw.randint(1, size))])]
        if number % 3 == 0:
            parts += [f"own{number}", line, f"own{number}"]
        rows.append((draw.randint(1, 70), draw.choice([" ", "\n", "\t "]).join(parts)))
    return rows + rows[:3]


@pytest.mark.parametrize(
    "rule",
    [
        substrings.SpanRule(),
        substrings.SpanRule(words=8, anchor=4, block=200),
        substrings.SpanRule(words=8, anchor=4, passages=1),
        substrings.SpanRule(words=8, anchor=2, passages=6, block=1),
    ],
)
def test_kept_words_equal_those_of_all_windows(spark, rule):
    rows = _shared_passages(rule.words) + odd_documents()
    frame = with_clashes(spark, rows, "doc_id long, text string", ("anchor", "passage", "spans", "kept", "hash", "id", "mask", "text_hash"))
    got = substrings.without_repeats(frame, rule).collect()
    wanted = _plain_spans(rows, rule.words)
    assert sum(n for _, _, n, _ in wanted) > 100
    assert _sorted(got) == _sorted(wanted)


def test_no_documents_no_spans(spark):
    assert substrings.without_repeats(spark.createDataFrame([], "doc_id long, text string")).count() == 0


def test_a_window_over_a_factor_boundary_is_found():
    # The second text's window begins inside the first text's factor and ends in the third one's.
    words = lambda text: np.array([ord(c) for c in text], np.uint64)
    texts = ["abcdefgh", "efghijkl", "cdefghijk", "abcdefghijkl"]
    bounds = np.cumsum([0, *map(len, texts)])
    keys = np.concatenate([words(t) for t in texts])
    for size in range(2, 9):
        found = substrings.repeated_windows(substrings.ReferenceBlock(keys, bounds, np.arange(4)), bounds, size)
        for n, text in enumerate(texts):
            for i in range(len(text)):
                held = len(text) - i >= size and any(text[i : i + size] in t for t in texts[:n])
                assert found[bounds[n] + i] == held, (size, n, i)


# --- ranked search


def _plain_ranks(docs, items, most=20):
    terms = lambda t: [x for x in _TERM.findall("".join(c.lower() if "A" <= c <= "Z" else c for c in t or ""))]
    rows = [(i, collections.Counter(terms(t))) for i, t in docs]
    sizes = [sum(c.values()) for _, c in rows]
    n, total = sum(s > 0 for s in sizes), sum(sizes)
    df = collections.Counter(t for _, c in rows for t in c)
    out = []
    for item_id, text in {(i, t) for i, t in items if t is not None}:
        scored = []
        for (doc_id, c), size in zip(rows, sizes):
            m = 75 + (25 * size * n) // max(total, 1)
            score = 0
            for t in terms(text):
                if c[t]:
                    w = math.floor(1000 * math.log((2 * n + 2) / (2 * df[t] + 1)))
                    score += w * ((1_000_000_000 * c[t]) // (1000 * c[t] + 12 * m))
            if score > 0:
                scored.append((-score, doc_id is None, doc_id or 0))
        out += [(item_id, k, None if none else i, -s) for k, (s, none, i) in enumerate(sorted(scored)[:most], 1)]
    return out


@pytest.mark.parametrize("rule", [ranked.RankRule(), ranked.RankRule(most=7, postings=60, together=2, block=30), ranked.RankRule(most=1, postings=1)])
def test_best_documents_equal_scores_of_all(spark, rule):
    draw = random.Random(2)
    docs = [(draw.randint(1, 150), random_text(draw, draw.choice([1, 5, 30, 90])).title()) for _ in range(120)] + odd_documents()
    docs += [(200 + i, "a copy of the same few words") for i in range(40)]
    items = [(i, random_text(draw, draw.randint(1, 12)) + ", W3 É") for i in range(9)] + [(3, "copy words"), (3, "copy words"), (10, None), (11, "..."), (None, "w5")]
    frame = with_clashes(spark, docs, "doc_id long, text string", ("rank", "score", "term", "query", "block"))
    asked = with_clashes(spark, items, "item_id long, text string", ("rank", "score", "query", "block"))
    got = ranked.best_documents(frame.repartition(3), asked, rule).collect()
    assert _sorted(got) == _sorted(_plain_ranks(docs, items, rule.most))


def test_search_of_nothing(spark):
    docs, items = spark.createDataFrame([], "doc_id long, text string"), spark.createDataFrame([], "item_id long, text string")
    some = spark.createDataFrame([(1, "word")], "item_id long, text string")
    assert ranked.best_documents(docs, some).count() == ranked.best_documents(docs, items).count() == 0


# --- alignment


def _plain_alignment(rows):
    import sentencepiece
    from tokenizers import Tokenizer

    first = Tokenizer.from_file(vocabulary("byte_bpe_50k.json"))
    first.encode_special_tokens = True
    second = sentencepiece.SentencePieceProcessor(model_file=vocabulary("piece_bpe_32k.model"))
    pair = alignment.TokenPair(vocabulary("byte_bpe_50k.json"), vocabulary("piece_bpe_32k.model"))
    found, counts = [], collections.Counter()
    for doc_id, text in rows:
        wanted = (" " + (text or "")).encode()
        a = first.encode(" " + text, add_special_tokens=False).ids if text else []
        b = second.encode(text) if text else []
        spelt = b"".join(pair._b_bytes[i] for i in b)
        if not text or spelt != wanted or first.decode(a, skip_special_tokens=False).encode() != wanted:
            found.append((doc_id, [], [], [], []))
            continue
        spans = []
        for ids, sizes in ((a, pair.a_sizes), (b, pair.b_sizes)):
            ends = np.cumsum(sizes[ids]).tolist()
            spans.append(list(zip([0, *ends], ends, ids)))
        links = [(x, y) for s, e, x in spans[0] for t, f, y in spans[1] if s < f and t < e]
        groups, low = [], 0
        for cut in sorted({e for _, e, _ in spans[0]} & {e for _, e, _ in spans[1]}):
            groups.append("|".join(",".join(str(i) for s, e, i in side if low <= s and e <= cut) for side in spans))
            low = cut
        found.append((doc_id, a, b, groups, links))
        counts.update(set(links))
    best = collections.Counter()
    for (a, _), n in counts.items():
        best[a] = max(best[a], n)
    return [
        (i, len(a), len(b), len(g), len(l), sum(counts[p] == best[p[0]] for p in l), sum(counts[p] for p in l), ";".join(g))
        for i, a, b, g, l in found
    ]


_TEXTS = [
    (1, "The quick brown fox."), (2, "The quick brown fox."), (2, "quick\nbrown   foxes\t\tin a row"), (3, "naïve café 😀 日本語 ñandú"),
    (4, "▁ is a sign of its own"), (5, "<|endoftext|> and </s> <s> <0x41>"), (6, None), (7, ""), (None, " "), (8, "  two blanks  "),
    (9, "x" * 300), (10, "\u0000 é\r\n"), (11, "ﬁ Å ½ ｆｕｌｌ"), (12, "12345 67,89 == != a_b"),
]


@pytest.mark.parametrize(
    "rule", [alignment.AlignRule(), alignment.AlignRule(parts=3, sums=2, held=16), alignment.AlignRule(parts=2, sent=0)]
)
def test_alignment_equals_all_pairs_of_tokens(spark, rule):
    rows = _TEXTS + [(20 + i, random_text(random.Random(i), 20)) for i in range(6)]
    frame = with_clashes(spark, rows, "doc_id long, text string", ("row", "a", "b", "pair", "part", "n", "groups"))
    got = alignment.aligned(frame.repartition(3), vocabulary("byte_bpe_50k.json"), vocabulary("piece_bpe_32k.model"), rule).collect()
    assert _sorted(got) == _sorted(_plain_alignment(rows))


def test_alignment_of_odd_and_no_documents(spark):
    files = vocabulary("byte_bpe_50k.json"), vocabulary("piece_bpe_32k.model")
    odd = odd_documents()
    got = alignment.aligned(spark.createDataFrame(odd, "doc_id long, text string"), *files).drop("groups").collect()
    assert sorted(r["n_a"] == 0 for r in got) == sorted(not t for _, t in odd)
    assert alignment.aligned(spark.createDataFrame([], "doc_id long, text string"), *files).count() == 0


@pytest.mark.parametrize("n", [0, 1, 2, 1000, 50_000])
def test_a_pair_hash_numbers_its_keys_without_gaps(n):
    keys = np.unique(np.random.default_rng(n).integers(0, 1 << 40, n))
    made = alignment.PairHash.of(keys)
    assert sorted(made(keys).tolist()) == list(range(len(keys)))
    again = alignment.PairHash.unpacked(*made.packed(), made.n)
    assert (again(keys) == made(keys)).all()
    assert sum(len(words) for words, _ in made._levels) * 64 < 5 * len(keys) + 64 * 40


def test_a_pair_that_was_not_counted_is_an_error():
    keys = np.array([5, 9])
    made = alignment.PairHash.of(keys)
    ordered = np.empty(2, np.int64)
    ordered[made(keys)] = keys
    levels, rest = made.packed()
    row = {"part": 0, "n": 2, "levels": levels, "rest": rest, "pairs": ordered.tobytes(), "counts": np.array([1, 1]).tobytes()}
    known = alignment.PairCounts([row], 1, 4, 3)
    assert known(keys).tolist() == [1, 1]
    with pytest.raises(ValueError):
        known(np.array([6]))


# --- as queries


def test_columns_of_the_queries(spark):
    wanted = {
        "op11_lempel_ziv_spans": "doc_id:bigint,n_words:bigint,n_removed:bigint,kept_sha256:string",
        "op12_range_maximum_search": "item_id:bigint,rank:int,doc_id:bigint,score:bigint",
        "op13_hashed_alignment": "doc_id:bigint,n_a:bigint,n_b:bigint,n_groups:bigint,n_links:bigint,n_best:bigint,count_sum:bigint,groups_sha256:string",
    }
    for name, columns in wanted.items():
        assert ",".join(f"{c}:{t}" for c, t in QUERIES[name](spark, DATA).dtypes) == columns


def test_alignment_query_equals_plain(spark):
    rows = [(r["doc_id"], r["text"]) for r in spark.read.parquet(f"{DATA}/documents.parquet").where("length(text) < 600").collect()]
    docs = spark.createDataFrame(rows, "doc_id long, text string")
    got = alignment.aligned(docs, vocabulary("byte_bpe_50k.json"), vocabulary("piece_bpe_32k.model")).collect()
    digest = lambda rows: _sorted((*r[:7], hashlib.sha256(r[7].encode()).hexdigest()) for r in rows)
    assert digest(got) == digest(_plain_alignment(rows))
