"""Packing, repetition, quality, byte pairs and personal data against plain versions of themselves."""

import collections
import os
import random
import re
import zlib

import numpy as np
import pyarrow as pa
import pytest

from fencewatch.llm import bpe, packing, pii, quality, repetition
from fencewatch.llm.queries import vocabulary
from tests.llm.cases import DATA, odd_documents, random_text, with_clashes

BYTES, WORDS = vocabulary("byte_bpe_50k.json"), vocabulary("word_bpe_49k.json")
pytestmark = pytest.mark.skipif(not os.path.exists(BYTES), reason="tokenizer files not there")


@pytest.fixture(scope="module")
def odd(spark):
    return with_clashes(spark, odd_documents(), "doc_id long, text string")


@pytest.fixture(scope="module")
def empty(odd):
    return odd.where("false")


# --- packing


def _library_pieces(rows):
    from tokenizers import Tokenizer

    library = Tokenizer.from_file(BYTES)
    for doc_id, text in rows:
        ids = library.encode(text or "", add_special_tokens=False).ids + [2]
        first = len(ids) % 1024 or 1024
        cuts = [0, *range(first, len(ids) + 1, 1024)]
        for piece, (a, b) in enumerate(zip(cuts, cuts[1:])):
            yield doc_id, piece, a, b - a, zlib.crc32(np.array(ids[a:b], "<u4").tobytes())


def test_packing_keeps_every_token_once(odd):
    rows = packing.pack_documents(odd, BYTES).collect()
    got = collections.Counter((r["doc_id"], r["piece"], r["start"], r["length"], r["ids_crc32"]) for r in rows)
    assert got == collections.Counter(_library_pieces(odd_documents()))
    sequences = collections.defaultdict(list)
    for r in rows:
        sequences[r["sequence_id"]].append((r["offset"], r["length"]))
    for parts in sequences.values():
        parts.sort()
        assert [a for a, _ in parts] == [sum(n for _, n in parts[:i]) for i in range(len(parts))]
        assert sum(n for _, n in parts) <= 1024


def test_packing_of_nothing(empty):
    assert packing.pack_documents(empty, BYTES).count() == 0


def test_two_replace_the_shortest():
    # Greedy: 6 and 3 leave a gap of 1; 3 goes for 2 + 2, which fill it.
    assert packing.fill([6, 3, 2, 2], 10) == [[6, 2, 2], [3]]


@pytest.mark.parametrize("seed", range(20))
def test_filling_uses_all_and_little_more_than_needed(seed):
    draw = random.Random(seed)
    lengths = [draw.randint(1, 100) for _ in range(draw.randint(0, 400))]
    bins = packing.fill(lengths, 100)
    assert sorted(n for b in bins for n in b) == sorted(lengths)
    assert all(sum(b) <= 100 for b in bins)
    assert len(bins) <= 1.1 * sum(lengths) / 100 + 2


# --- repetition


def _plain_repetition(text, least=8):
    words = re.findall(r"[^\x20\x09-\x0D]+", text or "")
    n = len(words)
    windows = collections.defaultdict(list)
    for i in range(n - 7):
        windows[tuple(words[i : i + 8])].append(i)
    inside, longest = set(), [0] * n
    for places in windows.values():
        if len(places) > 1:
            for i in places:
                inside.update(range(i, i + 8))
            for i in places:
                for j in places:
                    if i < j:
                        k = 8
                        while j + k < n and words[i + k] == words[j + k]:
                            k += 1
                        longest[i], longest[j] = max(longest[i], k), max(longest[j], k)
    covered = {p for i, k in enumerate(longest) if k >= least for p in range(i, i + k)}
    lines = [line for line in (text or "").split("\n") if re.search(r"[^\x20\x09-\x0D]", line)]
    symbols = len(re.findall(r"[#*$%&|<>]", text or ""))
    failed = n < 20 or 100 * len(inside) > 30 * n
    return n, sum(map(len, words)), symbols, len(lines) - len(set(lines)), len(inside), failed, len(covered), max(longest, default=0)


def test_repetition_equals_its_plain_version():
    draw = random.Random(3)
    made = [" ".join(draw.choice("abc") for _ in range(draw.randint(0, 150))) + draw.choice(["", "\n", "\na b\na b"]) for _ in range(200)]
    texts = [text for _, text in odd_documents() if not text or len(text) < 5000] + made + ["x y\n" * 30, "#<é>|\n\n"]
    got = repetition.measure(pa.array(texts, pa.string()))
    for i, text in enumerate(texts):
        *same, covered, most = _plain_repetition(text)
        assert [int(column[i]) for column in got[:6]] == [int(x) for x in same]
        assert round(got[7][i] * max(1, same[0])) == covered and got[8][i] == most


def test_long_repeat_is_rejected_and_others_stay(spark):
    draw = random.Random(9)
    passage, rest = random_text(draw, 60), [f"u{i}" for i in range(700)]
    rows = [(1, " ".join([*rest[:300], passage, *rest[300:600], passage])), (2, " ".join(rest)), (3, None)]
    frame = with_clashes(spark, rows, "doc_id long, text string")
    assert [r["doc_id"] for r in repetition.kept(frame).collect()] == [2]
    assert repetition.kept(frame).columns == frame.columns


def test_repetition_on_odd_rows(odd, empty):
    rows = repetition.measured(odd).collect()
    assert len(rows) == len(odd_documents()) and rows[0]["n_words"] == 0 and not rows[0]["kept"]
    assert repetition.measured(empty).count() == 0


# --- quality


def test_held_out_documents_are_judged_right(spark):
    documents, labels = (spark.read.parquet(f"{DATA.replace('0.001', '0.01')}/{t}.parquet") for t in ("documents", "labels"))
    network = quality.learned(documents, labels)
    scored = quality.scored(documents.select("doc_id", "text"), network)
    from pyspark.sql import functions as F

    rows = scored.join(labels, "doc_id").where(quality.held_out(F.col("doc_id"))).collect()
    right = [(r["score"] >= 0.3) == (r["quality"] == 1) for r in rows]
    assert len(rows) > 40 and sum(right) >= 0.95 * len(right)


def test_slopes_are_those_of_the_loss():
    network = quality.ByteNetwork(quality.Training(filters=3, hidden=4))
    for name in network.weights:
        network.weights[name] = network.weights[name].astype(np.float64)
    texts, labels = ["abc abc def " * 30, "x", "", "é" * 200], np.array([1.0, 0, 1, 0])
    x = quality.laid_out(pa.array(texts))

    def loss():
        logit = network.forward(x)[0]
        return float(np.mean(np.logaddexp(0, logit) - labels * logit))

    slopes = network.gradients(x, labels)
    for name, slope in slopes.items():
        flat = network.weights[name].reshape(-1)
        for i in np.argsort(-np.abs(slope.reshape(-1)))[:3]:
            old, step = flat[i], 1e-6
            flat[i] = old + step
            up = loss()
            flat[i] = old - step
            down = loss()
            flat[i] = old
            assert abs((up - down) / (2 * step) - slope.reshape(-1)[i]) < 2e-3 * max(1, abs(slope.reshape(-1)[i]) * 10)


def test_quality_without_labels_and_on_odd_rows(spark, odd, empty):
    nothing = spark.createDataFrame([], "doc_id long, quality int, toxic int")
    assert {r["score"] for r in quality.scored(odd, quality.learned(odd, nothing)).collect()} == {0.5}
    same = spark.createDataFrame([(i, 1, 0) for i in range(9)] + [(None, 1, 0), (2, None, 0)], "doc_id long, quality int, toxic int")
    network = quality.learned(odd, same)
    assert {r["score"] for r in quality.scored(odd, network).collect()} == {1.0}
    scores = [r["score"] for r in quality.scored(odd, quality.ByteNetwork(quality.Training())).collect()]
    assert len(scores) == len(odd_documents()) and all(0 <= s <= 1 for s in scores)
    assert quality.scored(empty, network).count() == 0
    assert quality.accepted(odd, network).columns == odd.columns


# --- byte pairs

ODD_TEXTS = ["", " ", "aaaa aaaaaaa", "x<|endoftext|>y <|startoftext|>", "don't 'LL", "a\u3000 b", "ΣΑΣ é e\u0301", "İ ﬁ ½ 123", "a\x1cb", "😀👍🏽!!", "日本語", "<|endoftext|"]


def test_byte_pairs_equal_the_library(spark, odd):
    from tokenizers import Tokenizer

    library = Tokenizer.from_file(WORDS)
    stored = [r["text"] for r in spark.read.parquet(f"{DATA}/documents.parquet").collect()]
    texts = ODD_TEXTS + stored + [t or "" for _, t in odd_documents()]
    own = bpe.WordBpe(WORDS)
    for text, ids in zip(texts, own.encode(texts)):
        wanted = library.encode(text, add_special_tokens=False).ids
        assert np.frombuffer(ids, "<i4").tolist() == wanted
        assert own.decode(np.array(wanted, np.int64)) == library.decode(wanted, skip_special_tokens=False)


def test_plain_chunks_of_a_batch_are_parted_together(monkeypatch):
    from tokenizers import Tokenizer

    library, own = Tokenizer.from_file(WORDS), bpe.WordBpe(WORDS)
    special = next(iter(own._special))
    rows = ["It's 'TIS we'll've don't'd 12a3 a-b...c !!", f"x{special}y{special.upper()} 's 'S", "\x1c\x1fA \x00 a\x0bb", "Zo\u00eb's z", "", "it's"]
    parted = []
    words_of = bpe.WordBpe._words
    monkeypatch.setattr(bpe.WordBpe, "_words", lambda self, chunk: parted.append(chunk) or words_of(self, chunk))
    for ids, text in zip(own.encode(rows), rows):
        assert np.frombuffer(ids, "<i4").tolist() == library.encode(text, add_special_tokens=False).ids
    assert len(parted) == 1 and special in parted[0]


def test_latin_chunks_are_parted_without_the_library(monkeypatch):
    from tokenizers import Tokenizer

    library, own = Tokenizer.from_file(WORDS), bpe.WordBpe(WORDS)
    draw = random.Random(9)
    signs = [chr(c) for c in range(0x100)] + list("aeÉß'sS \u00a0,.") * 8
    rows = ["".join(draw.choices(signs, k=draw.randint(1, 60))) for _ in range(3000)] + ["ÜBER l'été ¿qué? 1½² µm ×÷ ªº 'S\u00a0\u0085x"]
    asked = []
    words_of = bpe.WordBpe._library_words
    monkeypatch.setattr(bpe.WordBpe, "_library_words", lambda self, chunks: asked.extend(chunks) or words_of(self, chunks))
    ids = own.encode([*rows, "śx e\u0301"])
    assert [np.frombuffer(i, "<i4").tolist() for i in ids[:-1]] == [library.encode(r, add_special_tokens=False).ids for r in rows]
    assert sorted(asked) == ["e\u0301", "śx"]


def test_blanks_part_a_text_as_the_vocabulary_does():
    points = [chr(c) for c in range(0x110000) if not 0xD800 <= c < 0xE000]
    assert [c for c in points if (len(f"a{c}b".split()) == 2) != (len(bpe._CHUNK.findall(f"a{c}b")) == 2)] == list(bpe._SEPARATORS)
    assert bpe.chunks_of("a\x1cb c\u3000d") == ["a\x1cb", "c", "d"] and bpe.chunks_of(" a\u00a0b ") == ["a", "b"] and bpe.chunks_of("") == []


def test_a_full_store_keeps_the_words_of_the_batch(monkeypatch):
    monkeypatch.setattr(bpe, "KEPT_WORDS", 3)
    own, fresh = bpe.WordBpe(WORDS), bpe.WordBpe(WORDS)
    own.encode(["one two, three four"])
    parted = []
    merged = bpe.WordBpe._merged
    monkeypatch.setattr(bpe.WordBpe, "_merged", lambda self, words: parted.extend(words) or merged(self, words))
    got = own.encode(["one two, six"])
    assert parted == ["six"] and set(own._chunks) == {"one", "two,", "six"}
    assert got == fresh.encode(["one two, six"])


def test_every_code_point_gets_the_ids_of_the_library():
    from tokenizers import Tokenizer

    library, own = Tokenizer.from_file(WORDS), bpe.WordBpe(WORDS)
    dense = [c for c in range(0x20000) if not (0x3400 <= c < 0xA000 or 0xAC00 <= c < 0xD7A0 or 0xD800 <= c < 0xF900)]
    points = dense + [*range(0x3400, 0xA000, 97), *range(0xAC00, 0xD7A0, 97), *range(0xE000, 0xF900, 97), *range(0x20000, 0x110000, 97)]
    rows = [f"a{chr(c)}B {chr(c)}{chr(c)}'s 1{chr(c)}\u0301" for c in points]
    wanted = [e.ids for e in library.encode_batch(rows, add_special_tokens=False)]
    wrong = [hex(c) for c, a, b in zip(points, own.encode(rows), wanted) if np.frombuffer(a, "<i4").tolist() != b]
    assert not wrong, wrong[:20]


def test_byte_pairs_on_odd_rows(odd, empty):
    rows = bpe.encoded(odd, WORDS).collect()
    assert len(rows) == len(odd_documents())
    assert [(r["ids"], r["decoded"]) for r in rows[:3]] == [([], "")] * 3
    assert bpe.encoded(empty, WORDS).count() == 0


# --- personal data


def _plain_spans(text):
    found = [("email", m.start(), m.end()) for m in re.finditer(r"[A-Za-z0-9._%+-]+@[A-Za-z0-9-]+(\.[A-Za-z0-9-]+)+", text)]
    for m in re.finditer(r"[0-9]+(\.[0-9]+)(\.[0-9]+)(\.[0-9]+)", text):
        if all(int(x) <= 255 for x in m[0].split(".")):
            found.append(("ip", m.start(), m.end()))
    for m in re.finditer(r"[0-9]([\x20-]?[0-9])+", text):
        digits = re.sub("[^0-9]", "", m[0])
        if 16 <= len(digits) <= 19 and pii.luhn(digits):
            found.append(("card", m.start(), m.end()))
    for m in re.finditer(r"\+[0-9][\x20().0-9-]+[0-9]", text):
        if 8 <= len(re.sub("[^0-9]", "", m[0])) <= 15:
            found.append(("phone", m.start(), m.end()))
    return found


def test_base_spans_equal_the_plain_patterns(spark):
    draw = random.Random(2)
    texts = ["".join(draw.choice("aB1.2@+- ()%_3\n") for _ in range(draw.randint(0, 40))) for _ in range(5000)]
    texts += [r["text"] for r in spark.read.parquet(f"{DATA}/documents.parquet").collect()]
    for text in texts:
        assert pii.base_spans(text) == _plain_spans(text)


def test_field_finds_entities_of_texts_it_has_not_seen():
    field, hit, extra, missed = pii.trained(), 0, 0, 0
    for text, gold in pii.examples(200, seed=99):
        got = set(field.best(text))
        hit, extra, missed = hit + len(got & set(gold)), extra + len(got - set(gold)), missed + len(set(gold) - got)
    assert hit >= 0.97 * (hit + missed) and hit >= 0.97 * (hit + extra)


def test_method_adds_what_runs_together_and_base_stays():
    text = "call +1 (784) 555-8120 4111111111111111 or a.b@c.de 2024-05-06"
    assert pii.base_spans(text) == [("email", 43, 51)]
    assert [(k, text[a:b]) for k, a, b, _ in pii.all_spans(text, pii.trained())] == [
        ("email", "a.b@c.de"), ("card", "4111111111111111"), ("phone", "+1 (784) 555-8120"),
    ]


def test_masking(spark, odd, empty):
    rows = [(1, "mail a.b@c.de now", 17), (2, None, 0), (3, "none", 99)]
    got = pii.masked(with_clashes(spark, rows, "doc_id long, text string, n_chars long")).collect()
    assert [(r["text"], r["n_chars"]) for r in got] == [("mail <email> now", 16), (None, 0), ("none", 99)]
    assert len(pii.found(odd).collect()) == len(odd_documents())
    assert pii.found(empty).count() == 0 and pii.masked(empty).count() == 0


def test_entities_of_long_numeric_texts_are_found_wherever_they_stand():
    field, phone, card = pii.trained(), "(784) 555-8120", "4111.1111.1111.1111"
    for shift in range(40):
        text = "x" * shift + "; " + "id 12; " * 283 + f"{phone}; {card}; " + "id 12; " * 20
        assert [(k, text[a:b]) for k, a, b, _ in pii.all_spans(text, field)] == [("card", card), ("phone", phone)]
    # Numbers that only blanks part are one neighbourhood; one byte of history a token is kept.
    text = "12 " * 30_000
    assert len(pii._neighbourhoods(text)) == 1 and all(b <= len(text) for _, _, b, _ in pii.all_spans(text, field))


def test_neighbourhoods_change_no_labelling():
    draw, field = random.Random(12), pii.trained()
    parts = [t for t, _ in pii.examples(150, seed=5)] + ["é", "\n", "(", "@", "x" * 60, "... ", "12 34 ", "\u0663"]
    for _ in range(150):
        text = "".join(draw.choice(parts) for _ in range(draw.randint(1, 8)))
        base = pii.base_spans(text)
        added = [(k, a, b) for k, a, b in field.best(text) if all(b <= x or a >= y for _, x, y in base)]
        assert [s[:3] for s in pii.all_spans(text, field) if not s[3]] == sorted(added, key=lambda s: (pii.KINDS.index(s[0]), s[1]))


def test_long_runs_take_linear_time():
    assert pii.all_spans("a" * 300_000 + "@", pii.trained()) == []
    assert pii.base_spans("1" * 300_000) == []
