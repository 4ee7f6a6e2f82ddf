"""Token files: codes against brute force, exact round trips, places and checksums against the tokenizers library."""

import heapq
import random
import zlib

import numpy as np
import pytest
from concordia.llm import common, packing, queries, tokenfiles

SF = "/root/testdata/sf0.001"


def huffman_cost(counts):
    heap, cost = [c for c in counts if c], 0
    heapq.heapify(heap)
    while len(heap) > 1:
        a = heapq.heappop(heap) + heapq.heappop(heap)
        cost += a
        heapq.heappush(heap, a)
    return cost


def limited_cost(counts, limit):
    """Least cost of codes of at most limit bits, by trying all ways to fill the levels of the code tree."""
    counts = sorted((c for c in counts if c), reverse=True)

    def best(k, level, slots):
        if k == len(counts):
            return 0
        if level > limit or len(counts) - k > slots << (limit - level):
            return None
        found = None
        for take in range(min(slots, len(counts) - k) + 1):
            rest = best(k + take, level + 1, 2 * (slots - take))
            if rest is not None:
                cost = level * sum(counts[k : k + take]) + rest
                found = cost if found is None else min(found, cost)
        return found

    return best(0, 1, 2)


def test_lengths_are_optimal():
    rng = random.Random(2)
    for _ in range(40):
        counts = [rng.choice([0, 1, 1, 2, 5, rng.randrange(1000)]) for _ in range(rng.randrange(2, 9))]
        if sum(map(bool, counts)) < 2:
            continue
        for limit in (3, 4, 12):
            n = tokenfiles.code_lengths(np.array(counts), limit)
            assert all((x > 0) == (c > 0) and x <= limit for x, c in zip(n.tolist(), counts, strict=True))
            assert sum(2.0 ** -int(x) for x in n if x) == 1
            assert sum(int(x) * c for x, c in zip(n, counts, strict=True)) == limited_cost(counts, limit)
        assert limited_cost(counts, 12) == huffman_cost(counts)
    assert tokenfiles.code_lengths(np.array([0, 7, 0]), 12).tolist() == [0, 1, 0]
    assert tokenfiles.code_lengths(np.zeros(0, np.int64), 12).tolist() == []
    with pytest.raises(ValueError):
        tokenfiles.code_lengths(np.ones(9), 3)


def test_codes_are_canonical_and_prefix_free():
    lengths = tokenfiles.code_lengths(np.array([9, 0, 1, 30, 2, 2, 9]), 12)
    codes = tokenfiles.canonical(lengths)
    texts = {s: f"{int(c):0{n}b}" for s, (c, n) in enumerate(zip(codes, lengths.tolist(), strict=True)) if n}
    assert not any(a != b and texts[b].startswith(texts[a]) for a in texts for b in texts)
    assert sorted(texts, key=lambda s: (lengths[s], s)) == sorted(texts, key=lambda s: texts[s])


@pytest.mark.parametrize("symbols,limit", [(1, 12), (2, 12), (300, 12), (5000, 15), (70000, 25)])
def test_blocks_are_read_back(symbols, limit):
    rng = np.random.default_rng(symbols)
    blocks = [np.minimum(rng.zipf(1.3, n) - 1, symbols - 1).astype(np.int64) for n in (1, 255, 256, 257, 3000)]
    lengths = tokenfiles.code_lengths(np.bincount(np.concatenate(blocks), minlength=symbols), limit)
    codes, table = tokenfiles.canonical(lengths), tokenfiles.decoding_table(lengths, limit)
    text = lambda ids: "".join(f"{int(codes[i]):0{lengths[i]}b}" for i in ids)
    packed = [tokenfiles.pack_bits(b, lengths, codes) for b in blocks]
    for b, (raw, at) in zip(blocks, packed, strict=True):
        bits = text(b)
        assert "".join(f"{x:08b}" for x in raw)[: len(bits)] == bits and len(raw) == -(-len(bits) // 8)
        assert at.tolist() == np.cumsum([0, *lengths[b].tolist()])[:-1].tolist()
    out = tokenfiles.decode([p for p, _ in packed], [a[:: tokenfiles.STEP] for _, a in packed], [len(b) for b in blocks], table, limit)
    assert all((a == b).all() for a, b in zip(blocks, out, strict=True))
    raw = tokenfiles.make_block([5, None], [blocks[3], blocks[0]], 77, lengths, codes)
    ids, counts, first, points, payload = tokenfiles.parse_block(raw)
    assert (ids, counts.tolist(), first, len(points)) == ([5, None], [257, 1], 77, 2) and len(payload) < len(raw)
    with pytest.raises(ValueError):
        tokenfiles.parse_block(raw[:60] + bytes([raw[60] ^ 1]) + raw[61:])


def brute(texts, end):
    import tokenizers

    t = tokenizers.Tokenizer.from_file(queries.tokenizer())
    t.encode_special_tokens = True
    return [np.array([*t.encode(x or "", add_special_tokens=False).ids, end], "<u4").tobytes() for x in texts]


@pytest.mark.parametrize("block,file_bytes,part", [(1 << 16, 128 << 20, 256 << 20), (50, 3000, 5000)])
def test_files_hold_every_document_in_order(spark, monkeypatch, block, file_bytes, part):
    rng = random.Random(8)
    words = ["the", "of", "naïve", "漢字", "\U0001f600", "<|endoftext|>", "12", "a\x1cb", "\n\n", "  "]
    say = lambda n: " ".join(rng.choice(words) for _ in range(n))
    rows = [(5, None), (2, ""), (-9, "minus"), (2, "other of two"), (2, ""), (None, "without id"), (None, None), (1 << 40, say(4000)), (11, "x" * 9000)]
    rows += [(100 + i, say(rng.randrange(1, 60))) for i in range(80)] + [(777, "hot")] * 60
    df = spark.createDataFrame([(i, t, "f", 1, 2) for i, t in rows], "doc_id long, text string, ids string, first long, n_tokens long").repartition(5)
    for name, value in (("PART_BYTES", part), ("LEAST_BYTES", part), ("BLOCK_TOKENS", block), ("FILE_BYTES", file_bytes)):
        monkeypatch.setattr(tokenfiles, name, value)
    folder = common.fresh_path(spark, "token-files")
    index = tokenfiles.write_files(df, queries.tokenizer(), folder, end_id=0)
    got = tokenfiles.read_files(index, folder).collect()
    want = dict(zip([t for _, t in rows], brute([t for _, t in rows], 0), strict=True))
    assert sorted(((r["doc_id"], bytes(r["ids"])) for r in got), key=repr) == sorted(((i, want[t]) for i, t in rows), key=repr)
    got.sort(key=lambda r: r["start"])
    ids = [r["doc_id"] for r in got]
    assert ids == sorted(ids, key=lambda i: (i is not None, i or 0))
    at = 0
    for r in got:
        assert (r["start"], r["n_tokens"]) == (at, len(r["ids"]) // 4)
        at += r["n_tokens"]
    some = index.where("first >= 100")
    lowest = some.agg({"first": "min"}).first()[0]
    if lowest is not None:
        assert min(r["start"] for r in tokenfiles.read_files(some, folder).collect()) == lowest
    assert sum(r["n_tokens"] for r in index.collect()) == at
    assert tokenfiles.encode_and_read(df.where("false"), queries.tokenizer()).collect() == []


def test_query_equals_tokenizers(spark):
    docs = {r["doc_id"]: r["text"] for r in spark.read.parquet(f"{SF}/documents.parquet").select("doc_id", "text").collect()}
    order = sorted(docs)
    start = 0
    want = {}
    for i, ids in zip(order, brute([docs[i] for i in order], 0), strict=True):
        want[i] = (start, len(ids) // 4, zlib.crc32(ids))
        start += len(ids) // 4
    got = {r["doc_id"]: (r["start"], r["n_tokens"], r["ids_crc32"]) for r in queries.op12_token_files(spark, SF).collect()}
    assert got == want


def test_encoder_agrees_with_tokenizers_on_code_points():
    e = packing.CachedEncoder(queries.tokenizer())
    points = [c for c in [*range(0x3400), *range(0x3400, 0x110000, 61)] if not 0xD800 <= c < 0xE000]
    for lo in range(0, len(points), 4096):
        text = "".join(f"a{chr(c)}a 1{chr(c)}1 .{chr(c)}. {chr(c)} b{chr(c)}{chr(c)}\n" for c in points[lo : lo + 4096])
        assert e.encode(text) == np.array(e.hf.encode(text, add_special_tokens=False).ids, "<u4").tobytes()
