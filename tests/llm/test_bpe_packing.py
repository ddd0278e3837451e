import base64
import random

import public_tokenizers as P
import pytest
import tiktoken
from conftest import rows
from hypothesis import given, settings
from hypothesis import strategies as st

from lodestream.llm.bpe import PATTERN, default_vocabulary, encode_column, vocabulary
from lodestream.llm.packing import pack, round_robin, split_items


@pytest.fixture(scope="module")
def reference():
    ranks = {base64.b64decode(a): int(b) for a, b in map(bytes.split, open(P.path("byte_bpe_50k.tiktoken"), "rb"))}
    return tiktoken.Encoding("own", pat_str=P.PATTERN, mergeable_ranks=ranks, special_tokens={})


def test_ids_equal_the_public_tokenizer(reference):
    bpe, r = vocabulary(default_vocabulary()), random.Random(1)
    assert PATTERN == P.PATTERN
    pieces = ["the", " magnet", "ization", "\n\n", "  ", "'s", "Fe³⁺", "자석", "𝑀", "​", "0.5", "<|endoftext|>", "aaaa", "\t", "é", "—", "\x00", "ß"]
    for _ in range(2000):
        t = "".join(r.choice(pieces) for _ in range(r.randrange(40)))
        assert bpe.encode(t) == reference.encode_ordinary(t)
    for t in ("", None, "a" * 30000, "ab" * 9000, "!" * 9000, " " * 5000):
        assert bpe.encode(t) == ([] if not t else reference.encode_ordinary(t))


@settings(max_examples=300, deadline=None)
@given(st.text(max_size=80))
def test_any_text(text):
    bpe = vocabulary(default_vocabulary())
    ranks = {base64.b64decode(a): int(b) for a, b in map(bytes.split, open(P.path("byte_bpe_50k.tiktoken"), "rb"))} if not hasattr(test_any_text, "enc") else None
    if ranks:
        test_any_text.enc = tiktoken.Encoding("own", pat_str=P.PATTERN, mergeable_ranks=ranks, special_tokens={})
    assert bpe.encode(text) == test_any_text.enc.encode_ordinary(text)


def test_column(spark, reference):
    docs = spark.createDataFrame([(1, "A magnet.", "x", 1), (2, None, "x", 2), (3, "", None, 3), (1, "A magnet.", "x", 1)], "doc_id bigint, text string, ids string, id int")
    got = sorted((r.doc_id, list(r.ids)) for r in encode_column(docs).collect())
    assert got == [(1, reference.encode_ordinary("A magnet."))] * 2 + [(2, []), (3, [])]
    assert encode_column(docs.limit(0)).count() == 0
    assert rows(encode_column(docs, counts=True, keep=("ids",)))[-1] == (3, 0, None)


def test_round_robin_places_all_and_keeps_the_mix():
    r = random.Random(2)
    queues = {s: [(r.randrange(1, 60), (s, k)) for k in range(n)] for s, n in (("a", 600), ("b", 300), ("c", 100))}
    queues = {s: [(size, hash(k) % 10**9) for size, k in q] for s, q in queues.items()}
    total = {s: sum(x for x, _ in q) for s, q in queues.items()}
    share = {s: t / sum(total.values()) for s, t in total.items()}
    size = {k: (x, s) for s, q in queues.items() for x, k in q}
    boxes = round_robin({s: list(q) for s, q in queues.items()}, 200, share)
    assert sorted(k for b in boxes for k in b) == sorted(size)
    assert all(sum(size[k][0] for k in b) <= 200 for b in boxes)
    assert len(boxes) <= -(-sum(total.values()) // 200) + 2
    half = boxes[: len(boxes) // 2]
    sent = {s: sum(size[k][0] for b in half for k in b if size[k][1] == s) for s in queues}
    assert all(abs(sent[s] / sum(sent.values()) - share[s]) < 0.05 for s in queues)
    assert round_robin({}, 10, {}) == []


def test_pack(spark):
    r = random.Random(5)
    data = [(k, f"s{k % 3}" if k % 7 else None, r.randrange(0, 400)) for k in range(3000)] + [(9000, "s0", 5000), (9001, "s1", 2048), (9001, "s1", 2048), (9002, "s1", 2049), (9003, "s1", None), (9003, "s1", 10)]
    df = spark.createDataFrame(data, "doc_id bigint, source string, n_tokens bigint")
    for shards in (1, 50):
        got = pack(df, 2048, shard_containers=shards).collect()
        full = {}
        for x in got:
            if x.container:
                full[x.container] = full.get(x.container, 0) + x.n_tokens
        assert max(full.values()) <= 2048 and sum(full.values()) == sum(n or 0 for *_, n in data)
        parts = sorted((x.piece_no, x.token_start, x.n_tokens) for x in got if x.doc_id == 9000)
        assert parts == [(0, 0, 2048), (1, 2048, 2048), (2, 4096, 904)]
        assert all(x.container is None for x in got if x.n_tokens == 0)
        assert len(full) <= -(-sum(full.values()) // 2048) + (3000 * 200 // 2048 // shards if shards < 50 else 12)
    assert rows(split_items(pack(df))) == [(9000,), (9002,)]
    assert pack(df.limit(0)).count() == 0
    assert pack(df, weights={"s0": 0.9, "s1": 0.1}).count() == len(got)
