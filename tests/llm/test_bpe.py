"""Encoding against the vocabulary's own library; decoding as an exact round trip."""

import random

import public_tokenizers
from pyspark.sql import functions as F
from tokenizers import Tokenizer

from spendspark.llm import bpe

PATH = public_tokenizers.path("byte_bpe_50k.json")


def texts():
    random.seed(3)
    alphabet = "ab 1'\n\t\r\x0b\x0c\x85\xa0\x1c\x00é中😀٣²Ⅷ́s't"
    drawn = ["".join(random.choice(alphabet) for _ in range(random.randrange(60))) for _ in range(300)]
    return [None, "", "", "x" * 5000, "he said " * 4000, "a<|endoftext|>b <|endoftext|><|endoftext|>", *drawn]


def test_ids_equal_the_library(spark):
    rows = list(enumerate(texts()))
    df = spark.createDataFrame(rows, "doc_id long, text string").withColumn("ids", F.lit("clash")).withColumn("Extra", F.lit(1))
    got = {r.doc_id: r for r in bpe.encode(df, PATH, decoded="decoded").collect()}
    library = Tokenizer.from_file(PATH)
    for doc_id, text in rows:
        wanted = library.encode(text or "", add_special_tokens=False).ids
        assert got[doc_id].ids == wanted
        assert got[doc_id].decoded == library.decode(wanted, skip_special_tokens=False) == (text or "")
    assert got[0].text is None and got[0].Extra == 1


def test_decode_and_empty_table(spark):
    df = spark.createDataFrame([(1, [40, 716]), (2, None), (3, [])], "k int, ids array<int>")
    library = Tokenizer.from_file(PATH)
    assert [(r.k, r.decoded) for r in bpe.decode(df, PATH).orderBy("k").collect()] == [
        (1, library.decode([40, 716])), (2, ""), (3, "")]
    none = spark.createDataFrame([], "doc_id long, text string")
    assert bpe.digests(none, PATH).collect() == []


def test_merges_lowest_rank_first_and_leftmost():
    vocabulary = bpe.Vocabulary.__new__(bpe.Vocabulary)
    vocabulary.byte_ids = list(range(256))
    a, b = ord("a"), ord("b")
    vocabulary.merges = {(a, a): (1, 300), (a, b): (0, 301), (300, 301): (2, 302)}
    assert vocabulary.merge(b"aaab") == [302]
    assert vocabulary.merge(b"aaa") == [300, a]


def test_new_words_are_merged_at_once(monkeypatch):
    """The table of short words gives what the queue gives, word by word; only long words are left to the queue."""
    vocabulary = bpe.Vocabulary(open(PATH, encoding="utf-8").read())
    random.seed(5)
    words = ["".join(random.choice("abeinrst éß中😀1.") for _ in range(random.randrange(1, 70))) for _ in range(3000)]
    words += ["a", "aaaa", "x" * 64, "x" * 65, " the", "", "é"]
    monkeypatch.setattr(bpe, "ROWS", 500)
    assert vocabulary.merge_many(words) == [vocabulary.merge(w.encode()) for w in words]

    drawn = [t for t in texts() if t]
    wanted = [vocabulary.encode(t) for t in drawn]
    fresh = bpe.Vocabulary(open(PATH, encoding="utf-8").read())
    one_by_one = []
    monkeypatch.setattr(fresh, "merge", lambda data, merge=fresh.merge: one_by_one.append(data) or merge(data))
    monkeypatch.setattr(bpe, "AT_ONCE", 400)
    fresh.of_word.most = fresh.segments.most = 1 << 20
    assert list(fresh.encode_many([None, *drawn, None])) == [[], *wanted, []]
    assert all(len(data) > max(bpe.WIDTHS) for data in one_by_one)
    # caches that overflow within a group lose nothing
    fresh.of_word.most = fresh.segments.most = 7
    assert list(fresh.encode_many(drawn)) == wanted
    empty = bpe.PairTable({}, list(range(256)))
    assert empty.merge([b"ab", b"c"], 8) == [[97, 98], [99]]


def test_words_of_latin_letters_need_no_pattern():
    vocabulary = bpe.Vocabulary(open(PATH, encoding="utf-8").read())
    segments = [s for t in texts() if t for s in bpe.SEGMENTS.findall(t)]
    segments += [a + chr(c) + b for c in range(0x260) for a in ("", " ", "x", " x", "'") for b in ("", "s", "1")]
    assert all(vocabulary.split(s) == vocabulary.words.findall(s) for s in segments)


def test_texts_cut_by_splitting_give_the_words_of_the_pattern():
    """Cuts at single spaces and line breaks cross no word; runs of white space and texts with the mark go by the pattern."""
    vocabulary = bpe.Vocabulary(open(PATH, encoding="utf-8").read())
    random.seed(6)
    drawn = ["".join(random.choice(["a", "B", "é", "中", "1", ".", "'s", " ", " ", "\n", "\t", "\u3000", end]) for _ in range(random.randrange(0, 30)))
             for end in ("x", "\0", "  ") for _ in range(1500)]
    for text in drawn:
        parts = bpe.segments_of(text)
        assert "".join(parts) == text
        assert [w for s in parts for w in vocabulary.words.findall(s)] == vocabulary.words.findall(text)


def test_a_word_is_merged_without_moving_its_symbols():
    """A round looks at the words that still have pairs; places are kept, so ties go to the left in words of the full width."""
    vocabulary = bpe.Vocabulary(open(PATH, encoding="utf-8").read())
    words = [b"a" * n for n in range(1, 65)] + [b"ab" * 32, b" the" * 16, b"x"]
    assert vocabulary.table.merge(words, 64) == [vocabulary.merge(w) for w in words]
