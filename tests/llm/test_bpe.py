import hashlib
import random

import public_tokenizers
import tiktoken
from edges import ALL_IDS, ROWS, edge, empty, ids

from millrace.llm import bpe

PATH, PATTERN = public_tokenizers.path("byte_bpe_50k.tiktoken"), public_tokenizers.PATTERN
CODEC = bpe.Codec(bpe.read_ranks(PATH), PATTERN)
PLAIN = tiktoken.Encoding("own", pat_str=PATTERN, mergeable_ranks=CODEC.ranks, special_tokens={})


def unpacked(b):
    return [int.from_bytes(b[k : k + 4], "little") for k in range(0, len(b), 4)]


def test_same_ids_as_the_library():
    rng = random.Random(3)
    texts = ["", " ", "a" * 5000, " " * 999, "ab" * 2000, "\n\n x"] + ["".join(rng.choice("abc \n'stlre1é漢 😀xyz_-=") for _ in range(rng.randint(1, 300))) for _ in range(150)]
    for t, packed in zip(texts, CODEC.encode_all(texts), strict=True):
        assert unpacked(packed) == PLAIN.encode_ordinary(t)
        assert CODEC.decode(packed) == t.encode()


def brute(tokens, piece):
    """Always the lowest rank, the leftmost of equals."""
    ranks, parts = {t: k for k, t in enumerate(tokens)}, [bytes([b]) for b in piece]
    if piece in ranks:
        return [ranks[piece]]
    while True:
        found = min(((ranks[a + b], k) for k, (a, b) in enumerate(zip(parts, parts[1:], strict=False)) if a + b in ranks), default=None)
        if found is None:
            return [ranks[p] for p in parts]
        parts[found[1] : found[1] + 2] = [parts[found[1]] + parts[found[1] + 1]]


def test_vocabularies_out_of_order():
    """Ranks that no training would give: a merge can make a pair of lower rank than its own."""
    rng = random.Random(5)
    for _ in range(60):
        more = list({bytes(rng.choice(b"abc") for _ in range(rng.randint(2, 5))) for _ in range(25)})
        rng.shuffle(more)
        tokens = [bytes([b]) for b in range(256)] + more
        codec = bpe.Codec(tokens, ".+")
        pieces = [bytes(rng.choice(b"abc") for _ in range(rng.randint(1, 40))) for _ in range(20)]
        pieces = [p for p in pieces if p not in codec.ranks]
        assert [unpacked(x) for x in codec.merge(pieces)] == [brute(tokens, p) for p in pieces]


def test_edge_rows(spark):
    rows = bpe.token_digests(edge(spark), PATH, PATTERN).collect()
    assert ids(rows) == ALL_IDS
    texts = {r[0]: r[1] or "" for r in ROWS}
    for r in rows:
        expected = PLAIN.encode_ordinary(texts[r.doc_id])
        assert r.n_tokens == len(expected)
        assert r.ids_sha256 == hashlib.sha256(b"".join(k.to_bytes(4, "little") for k in expected)).hexdigest()
        assert r.decoded_sha256 == hashlib.sha256(texts[r.doc_id].encode()).hexdigest()
    assert bpe.token_digests(empty(spark), PATH, PATTERN).count() == 0
    assert sorted(map(str, bpe.token_digests(edge(spark), PATH, PATTERN, lasting=True).collect())) == sorted(map(str, bpe.token_digests(edge(spark), PATH, PATTERN).collect()))


def test_ids_do_not_depend_on_the_cache(monkeypatch):
    """A cache that turns over all the time against one that holds everything."""
    tokens = bpe.read_ranks(public_tokenizers.path("byte_bpe_50k.tiktoken"))
    texts = [" ".join(f"word{k * j % 97} thing{j}x" for j in range(40)) for k in range(60)]
    large = bpe.Codec(tokens, public_tokenizers.PATTERN)
    want = [large.encode_all([t])[0] for t in texts]
    monkeypatch.setattr(bpe, "CACHE_ENTRIES", 10)
    small = bpe.Codec(tokens, public_tokenizers.PATTERN)
    assert [small.encode_all([t])[0] for t in texts] == want == small.encode_all(texts) and len(small.older) < len(large.cache)


def test_a_call_begins_with_an_empty_cache():
    codec = bpe.Codec(bpe.read_ranks(PATH), PATTERN)
    codec.begin("one")
    codec.encode_all(["several words here"])
    codec.begin("one")
    assert codec.cache
    codec.begin("two")
    assert not codec.cache and not codec.older
