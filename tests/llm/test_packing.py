import random
import zlib
from collections import Counter

import numpy as np
from tokenizers import Tokenizer

from tests.llm.helpers import LONG, ODD, docs, empty, odd
from tidelog.llm import packing as P
from tidelog.llm.common import tokenizer_path


def test_histogram_packing_is_whole_and_near_the_bound():
    rng = random.Random(3)
    for n, top in ((0, 10), (1, 10), (500, 1024), (3000, 300), (200, 5), (400, 600)):
        counts = Counter(rng.randint(1, top) for _ in range(n))
        bins = P.pack_histogram(counts)
        held = Counter()
        for b in bins:
            assert b.count > 0 and sum(s * k for s, k in b.items) <= 1024
            for s, k in b.items:
                held[s] += k * b.count
        assert held == counts
        bound = -(-sum(s * c for s, c in counts.items()) // 1024)
        assert sum(b.count for b in bins) <= bound * 11 / 9 + 1


def best(sizes, capacity):
    """The fewest sequences, by trying all ways."""
    sizes = sorted(sizes, reverse=True)
    found = [len(sizes)]

    def go(i, bins):
        if len(bins) >= found[0]:
            return
        if i == len(sizes):
            found[0] = len(bins)
            return
        for room in set(b for b in bins if b >= sizes[i]):
            j = bins.index(room)
            go(i + 1, [*bins[:j], room - sizes[i], *bins[j + 1 :]])
        go(i + 1, [*bins, capacity - sizes[i]])

    go(0, [])
    return found[0]


def test_dominated_sets_cost_nothing():
    """What is fixed and the best packing of the rest are as few as the best packing of all."""
    rng = random.Random(8)
    for _ in range(150):
        sizes = [rng.randint(1, 20) for _ in range(rng.randint(1, 9))]
        left = dict(Counter(sizes))
        fixed = sum(b.count for b in P.dominated(left, 20))
        rest = [s for s, c in left.items() for _ in range(c)]
        assert fixed + best(rest, 20) == best(sizes, 20)


def test_ids_are_those_of_the_tokenizer():
    t = Tokenizer.from_file(tokenizer_path("byte_bpe_50k.json"))
    t.encode_special_tokens = True
    own = P.tokenizer()
    texts = ["", " ", "a", " a", "a ", "a  b", "a\n b", "it's we'll I'd 's", "x\u00a0y z", "tab\t tab", "\u00e9t\u00e9 \U0001f600 12 345", "a\x1c b", " <|endoftext|> b", "don 't  '", *[t for _, t, *_ in ODD if t]]
    for text in texts:
        assert np.frombuffer(own(text), "<u4").tolist() == t.encode(text, add_special_tokens=False).ids, repr(text)


def test_round_trip(spark):
    t = Tokenizer.from_file(tokenizer_path("byte_bpe_50k.json"))
    t.encode_special_tokens = True
    got = P.pack(odd(spark)).toPandas()
    for _, own in got.groupby("sequence_id"):
        own = own.sort_values("offset")
        assert own.length.sum() <= 1024 and own.offset.tolist() == (own.length.cumsum() - own.length).tolist()
    long = got[got.doc_id == 5].sort_values("piece")
    ids = np.array([*t.encode(LONG, add_special_tokens=False).ids, 2], "<u4")
    assert long.start.tolist() == (long.length.cumsum() - long.length).tolist() and long.length.sum() == len(ids) and (long.length[1:] == 1024).all()
    assert [zlib.crc32(ids[s : s + n].tobytes()) for s, n in zip(long.start, long.length)] == long.ids_crc32.tolist()
    assert got[got.doc_id == 1].length.tolist() == [1] and len(got[got.doc_id == 3]) == 2
    assert P.pack(empty(spark)).count() == 0


def test_shards_of_one_size(spark):
    """A size ranked in many shards fills the same sequences, each place once."""
    items = spark.range(700).selectExpr("id AS doc_id", "0 AS piece", "0L AS start", "CASE WHEN id % 3 = 0 THEN 500L WHEN id % 3 = 1 THEN 1024L ELSE 24L END AS length", "id AS ids_crc32")  # 117 shards a size at 2 each, 64 at 1000
    places = lambda n: sorted(P.place(items, per_shard=n).select("length", "sequence_id", "offset").collect())
    many = places(2)
    assert len(many) == 700 and len({r[1:] for r in many}) == 700 and many == places(1000)


def test_added_tokens_are_their_own_ids(spark):
    t = Tokenizer.from_file(tokenizer_path("byte_bpe_50k.json"))
    end = "<|endoftext|>"
    texts = [f"ab {end} cd", end, f"{end}{end}", f" {end} b", f"a  {end}\n b", f"<|endoftext{end}|>", f"don't {end}'s", f"\u00e9t\u00e9{end}12 345 ", "<|ENDOFTEXT|>", *[t for _, t, *_ in ODD if t]]
    got = {r.doc_id: (r.length, r.ids_crc32) for r in P.pieces(docs(spark, [(i, x, None, None) for i, x in enumerate(texts)]), capacity=1 << 30).collect()}
    for i, x in enumerate(texts):
        ids = np.array([*t.encode(x, add_special_tokens=False).ids, 2], "<u4")
        assert got[i] == (len(ids), zlib.crc32(ids.tobytes())), x[:40]
