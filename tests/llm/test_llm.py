"""The operators for training text against brute force, round trips and edge cases."""

from __future__ import annotations

import json
import math
import os
import random
import re
import zlib
from collections import defaultdict

import numpy as np
import public_tokenizers
import pyarrow as pa
import pytest
import sentencepiece
from pyspark.sql import Window
from pyspark.sql import functions as F
from sentencepiece import sentencepiece_model_pb2
from tokenizers import Tokenizer, models

from mailsift.llm import chat, common, embeddings, mixing, neighbours, personal, pieces, quality, queries, sharding, tokencounts, tokenfiles
from mailsift.llm.components import components

WORD = re.compile(common.WORD)
DOCS = "doc_id long, text string, lang string, source string, n_chars long, kept boolean, size long"


@pytest.fixture(scope="module")
def odd(spark):
    """Documents with nulls everywhere, empty and long texts, ties, repeated rows, and columns named as results are."""
    base = "alpha beta gamma delta epsilon zeta eta theta iota kappa lambda mu nu xi omicron pi rho sigma tau upsilon"
    rows = [
        (1, base, "en", "a", 10, True, 5), (2, base, "en", "a", 10, None, 5), (3, base.upper(), "en", "b", 10, True, 5),
        (4, base + " one two three", None, "b", None, True, 5), (5, None, "en", "a", 0, True, 5), (6, "", "en", None, 0, True, 5),
        (7, " \t\n ", "en", "c", 0, True, 5), (8, "two words", "en", None, 9, True, 5), (9, "Two  WORDS", "en", "é", 9, True, 5),
        (10, "x " * 60_000, "en", "a", 120_000, True, 5), (11, "a@b.c or +1 (017) 555-7713, card 4111 1111 1111 1111, at 10.0.0.1 not 300.1.1.1", "en", "b", 9, True, 5),
        (12, "日本語 ☃ 😀 é  ü", "ja", "c", 9, True, 5), (12, "日本語 ☃ 😀 é  ü", "ja", "c", 9, True, 5), (None, base, "en", "a", 10, True, 5),
    ]
    return spark.createDataFrame(rows, DOCS).repartition(3)


@pytest.fixture(scope="module")
def empty(spark):
    return spark.createDataFrame([], DOCS)


def quality_brute(text: str | None) -> tuple[int, ...]:
    text = text or ""
    words, places, seen, repeats = WORD.findall(text), defaultdict(list), set(), 0
    for i in range(len(words) - 4):
        places[tuple(words[i : i + 5])].append(i)
    covered = {j for v in places.values() if len(v) > 1 for i in v for j in range(i, i + 5)}
    for line in text.split("\n"):
        if WORD.search(line):
            repeats += line in seen
            seen.add(line)
    return len(words), sum(map(len, words)), sum(c in "#*$%&|<>" for c in text), repeats, len(covered)


def test_quality_measures_equal_brute_force():
    r = random.Random(1)
    texts = [None, "", "  \n\n"] + ["".join(r.choice(["a", "b", "é ", "\n", "#", "x y z u v ", " ", "\t"]) for _ in range(r.randint(0, 80))) for _ in range(500)]
    found = quality.measured(pa.array(texts), np.zeros(1024), -1.0)
    names = ("n_words", "word_chars", "n_symbols", "n_dup_lines", "n_repeat_words")
    for i, text in enumerate(texts):
        assert tuple(int(found[k][i]) for k in names) == quality_brute(text)


def test_quality_ratio_against_counts(spark):
    texts = ["good plain words here and there for you to read now"] * 6 + ["bad ### words $$$ all ### over &&& the ### page $$$ here ###"] * 6
    docs = spark.createDataFrame(list(enumerate(texts)), "doc_id long, text string")
    trusted = spark.createDataFrame([(i,) for i in range(4)], "doc_id long")
    rows = {r["doc_id"]: r for r in quality.quality(docs, trusted).collect()}
    assert rows[0]["kept"] and rows[5]["kept"] and not rows[6]["kept"] and rows[0]["llr"] > 0 > rows[6]["llr"]
    # the mean log ratio from plain counts over the same buckets
    counts = np.zeros((2, quality.BUCKETS))
    for i, text in enumerate(texts):
        for bucket in quality.features(*common.text_bytes(pa.array([text])), quality.BUCKETS)[0].tolist():
            counts[0, bucket] += i < 4
            counts[1, bucket] += 1
    own = quality.features(*common.text_bytes(pa.array([texts[6]])), quality.BUCKETS)[0].tolist()
    share = lambda k, b: counts[k, b] / counts[k].sum() + 1 / quality.BUCKETS
    assert rows[6]["llr"] == pytest.approx(sum(math.log(share(0, b) / share(1, b)) for b in own) / len(own))


def test_quality_edges(spark, odd, empty):
    trusted = spark.createDataFrame([(1,), (1,), (None,)], "doc_id long")
    rows = quality.quality(odd, trusted).collect()
    assert len(rows) == odd.count()
    assert all(r["base_failed"] and not r["kept"] for r in rows if r["doc_id"] in (5, 6, 7, 8, 10))
    assert quality.keep_good(odd, trusted).columns == odd.columns
    assert quality.quality(empty, trusted).count() == 0 and quality.keep_good(empty, trusted).count() == 0
    assert quality.quality(odd, trusted.limit(0)).where("llr <> 0").count() == 0


def base_brute(text: str) -> list[tuple[int, int, str]]:
    out = [(*m.span(), "email") for m in re.finditer(r"[A-Za-z0-9._%+-]+@[A-Za-z0-9-]+(\.[A-Za-z0-9-]+)+", text)]
    out += [(*m.span(), "ip") for m in re.finditer(r"[0-9]+(\.[0-9]+)(\.[0-9]+)(\.[0-9]+)", text) if all(int(p) <= 255 for p in m[0].split("."))]
    for m in re.finditer(r"[0-9]([\x20-]?[0-9])+", text):
        digits = re.sub("[^0-9]", "", m[0])
        if 12 <= len(digits) <= 19 and sum(sum(divmod(int(c) * (1 + k % 2), 10)) for k, c in enumerate(digits[::-1])) % 10 == 0:
            out.append((*m.span(), "card"))
    out += [(*m.span(), "phone") for m in re.finditer(r"\+[0-9][\x20().0-9-]+[0-9]", text) if 9 <= len(re.sub("[^0-9]", "", m[0])) <= 15]
    return sorted(out, key=lambda s: (s[0], personal.KINDS.index(s[2]), s[1]))


def test_base_spans_equal_patterns():
    r = random.Random(3)
    parts = ["1", "2", "4", "0", "5", "+", "@", ".", "-", " ", "a", "b.c", "é", "(", ")", "192.168.1.1", "4111 1111 1111 1111", "a@b.c", "+1 23"]
    for _ in range(20_000):
        text = "".join(r.choice(parts) for _ in range(r.randint(0, 24)))
        assert personal.base_spans(text) == base_brute(text), text


def test_base_spans_are_linear_in_long_words():
    for text in ("a" * 200_000, "1" * 200_000, "1." * 100_000, "a@" * 100_000, "+1 " * 60_000):
        personal.base_spans(text)


def segmentations(n, spans):
    """All segmentations of an island into candidate entities, as tuples of candidates."""
    if n == 0:
        return [()]
    out = list(segmentations(n - 1, [s for s in spans if s[1] < n]))
    for k in spans:
        if k[1] == n:
            out += [(*rest, k) for rest in segmentations(k[0], [s for s in spans if s[1] <= k[0]])]
    return out


def test_semi_markov_sums_and_best_equal_enumeration():
    r = np.random.default_rng(2)
    for n in (1, 3, 5):
        spans = [(i, j) for i in range(n) for j in range(i + 1, min(n, i + 3) + 1)]
        weights = r.normal(size=(len(personal.KINDS), len(spans)))
        candidates = [(*s, np.array([k])) for k, s in enumerate(spans)]
        joint = np.log(np.exp(weights).sum(axis=0))
        every = segmentations(n, spans)
        mass = [math.exp(sum(joint[spans.index(s)] for s in seg)) for seg in every]
        want = [sum(m for seg, m in zip(every, mass, strict=True) if s in seg) / sum(mass) for s in spans]
        assert personal.expected(n, spans, joint.tolist()) == pytest.approx(want)
        top = max(every, key=lambda seg: sum(weights[:, spans.index(s)].max() for s in seg))
        assert [(i, j) for i, j, _ in personal.best(weights, n, candidates, 0.0)] == list(top)


def test_field_adds_what_patterns_miss_and_masks(spark):
    r = random.Random(5)
    texts = []
    for k in range(60):
        octets = ".".join(str(r.randint(1, 250)) for _ in range(4))
        texts.append(f"Some words here {octets} and then +1 ({r.randint(100, 999)}) 555-{r.randint(1000, 9999)} of it, mail x{k}@mail{k % 7}.example.com now 4111 1111 1111 1111 end in {1900 + k}")
    docs = spark.createDataFrame(list(enumerate(texts)), "doc_id long, text string")
    weights = personal.train(docs)
    base, spans = personal.found_spans("words 4111.1111.1111.1111 more words of 1999 and 12 things", weights)
    assert base == [] and spans == [(6, 25, "card")]
    for clean in ("released in 1999 and 2004 by 35 people", "version 2.0.1 of 12", "nothing at all"):
        assert personal.found_spans(clean, weights)[1] == []
    assert personal.masked("to a@b.de or 10.0.0.1.", weights) == "to <EMAIL> or <IP>."


def test_written_out_addresses_without_digits(spark):
    r = random.Random(7)
    word = lambda: "".join(r.choice("abcdefghij") for _ in range(r.randint(3, 8)))
    texts = [f"Some {word()} here, mail {word()}.{word()}@{word()}.example.com or {word()}@{word()}.org now, at {word()} since {1900 + k}." for k in range(60)]
    weights = personal.train(spark.createDataFrame(list(enumerate(texts)), "doc_id long, text string"))
    forms = {
        "write to jane.doe (at) example.com for more": "write to <EMAIL> for more",
        "write to jane [at] example [dot] org for more": "write to <EMAIL> for more",
        "of 12 people jane.doe (at) example.com is one": "of 12 people <EMAIL> is one",
        "Max.Muster[AT]mail.example.com": "<EMAIL>",
    }
    clean = ["we met at home. Then we left", "look (at) this", "nothing at all"]
    docs = spark.createDataFrame(list(enumerate([*forms, *clean])), "doc_id long, text string")
    assert [x["text"] for x in personal.mask(docs, weights).orderBy("doc_id").collect()] == [*forms.values(), *clean]
    spans = [x["spans"] for x in personal.personal_data(docs, weights).orderBy("doc_id").collect()]
    assert spans == ["email:9:34", "email:9:36", "email:13:38", "email:0:30", "", "", ""]
    plain = "ask jane at example.com or jane at example (dot) org"
    assert sum(len(x) > 0 for x in personal.islands(plain, [])) > 0 and {plain[x[i][0] : x[j - 1][1]] for x in personal.islands(plain, []) for i, j, _ in personal.segments(plain, x)} >= {"jane at example.com", "jane at example (dot) org"}


def test_personal_edges(odd, empty):
    weights = np.zeros((len(personal.KINDS), len(personal.FEATURES))) - 1
    rows = [r for r in personal.personal_data(odd, weights).collect() if r["doc_id"] == 11]
    assert [rows[0][f"n_{k}"] for k in personal.KINDS] == [1, 1, 1, 1]
    assert personal.personal_data(empty).count() == 0
    out = personal.mask(odd, weights)
    assert out.columns == odd.columns and out.count() == odd.count()
    assert out.where("doc_id = 5").first()["text"] is None
    assert out.where("doc_id = 11").first()["n_chars"] == len(out.where("doc_id = 11").first()["text"])


def targets_brute(sizes: dict, percent=150, most=2) -> dict:
    names = sorted(sizes, key=lambda s: (s is None, s or ""))
    weight = {s: (3, 1, 2)[i % 3] for i, s in enumerate(names)}
    total, capped = percent / 100 * sum(sizes.values()), set()
    while True:
        left, share = total - sum(most * sizes[s] for s in capped), sum(w for s, w in weight.items() if s not in capped)
        out = {s: most * sizes[s] if s in capped else left * weight[s] / share for s in names}
        over = {s for s in names if out[s] > most * sizes[s] + 1e-9}
        if not over - capped:
            return out
        capped |= over


def test_mix_targets_and_copies(spark):
    r = random.Random(4)
    sizes = {"a": 400, "b": 30, "c": 5, None: 60, "é": 90, "z": 0}
    rows = [(i * 10 + k, "w " * r.randint(1, 30) if s != "z" else "", s) for i, (s, n) in enumerate(sizes.items()) for k in range(max(1, n))]
    docs = spark.createDataFrame([(i, t, s) for i, (_, t, s) in enumerate(rows)], "doc_id long, text string, source string")
    found = mixing.mix(docs).collect()
    assert len(found) == len(rows) and found == mixing.mix(docs).collect() or sorted(found) == sorted(mixing.mix(docs).collect())
    of = {i: s for i, (_, _, s) in enumerate(rows)}
    totals, taken, targets = defaultdict(int), defaultdict(int), {}
    for x in found:
        totals[of[x["doc_id"]]] += x["size"]
        taken[of[x["doc_id"]]] += x["taken"]
        targets[of[x["doc_id"]]] = x["target"]
        assert 0 <= x["copies"] <= 2 and x["taken"] == x["copies"] * x["size"]
    assert targets == pytest.approx(targets_brute(dict(totals)))
    assert all(abs(taken[s] - targets[s]) <= 60 for s in totals)
    # the copies of a source are the integers crossed: their number is the expected one, up to one
    for s in totals:
        n, copies = sum(1 for x in found if of[x["doc_id"]] == s), sum(x["copies"] for x in found if of[x["doc_id"]] == s)
        assert totals[s] == 0 and copies == 0 or abs(copies - n * targets[s] / totals[s]) <= 1


def test_mix_edges(odd, empty):
    assert mixing.mix(odd).count() == odd.count() and mixing.mix(empty).count() == 0
    out = mixing.mixed(odd)
    assert out.columns == odd.columns and out.count() >= odd.count() // 2
    assert mixing.mixed(empty).count() == 0


def test_shards_are_even_gapless_and_keep_copies(spark):
    r = random.Random(6)
    texts = ["same text " * 5] * 300 + ["".join(r.choice("abc ") for _ in range(r.randint(0, 300))) for _ in range(900)]
    docs = spark.createDataFrame(list(enumerate(texts)), "doc_id long, text string")
    rows = sharding.shards(docs, full=50).collect()
    per_shard, split = defaultdict(list), defaultdict(set)
    for x in rows:
        assert (x["size"], x["text_crc32"]) == (len(texts[x["doc_id"]].encode()) + 1, zlib.crc32(texts[x["doc_id"]].encode()))
        per_shard[x["shard"]].append(x)
        split[texts[x["doc_id"]]].add(x["shard"])
    total = sum(x["size"] for x in rows)
    assert all(abs(sum(x["size"] for x in v) - total / 16) <= 301 for v in per_shard.values())
    assert all(sorted(x["slot"] for x in v) == list(range(len(v))) for v in per_shard.values())
    assert sum(len(v) - 1 for v in split.values()) <= 15
    assert all(max(v) - min(v) == len(v) - 1 for v in split.values())


def test_shard_edges_and_files(spark, odd, empty, tmp_path):
    assert sharding.shards(empty).count() == 0
    rows = sharding.shards(odd).collect()
    assert len(rows) == odd.count() and next(x for x in rows if x["doc_id"] == 5)["text_crc32"] == 0
    sharding.write_shards(odd.drop("kept"), f"{tmp_path}/shards", 4)
    back = spark.read.parquet(f"{tmp_path}/shards")
    assert back.count() == odd.count() and back.select("shard").distinct().count() <= 4


def test_position_is_binary_search(spark):
    begins = sharding.bounds([5, 5, 9, -3])
    assert begins == [-3, 5, 6, 9]
    keys = spark.createDataFrame([(k,) for k in range(-5, 12)], "key long")
    for row in keys.select("key", sharding.position(keys["key"], begins).alias("p")).collect():
        assert row["p"] == sharding.range_of(row["key"], begins)


def test_sentencepiece_parity_and_round_trip():
    codec = pieces.Codec(public_tokenizers.path("piece_bpe_32k.model"))
    processor = sentencepiece.SentencePieceProcessor(model_file=public_tokenizers.path("piece_bpe_32k.model"))
    texts = ["", "  two  blanks ", "\n\nx", "日本語 é ☃ 😀", "▁a ▁b", "a  b", "<s> hi </s>", "x\ty", "é ﬁ", " ", "a ", "Plain words, and more: 12.5%!"]
    ids, n, parity, restored = codec.encode(texts)
    ends = np.cumsum(n)
    assert [ids[b - k : b].tolist() for b, k in zip(ends, n, strict=True)] == processor.encode(texts)
    assert parity.all() and restored.all()
    for text, b, k in zip(texts, ends, n, strict=True):
        assert codec.decode(ids[b - k : b].tolist()) == text.replace("▁", " ")


@pytest.fixture(scope="module")
def unigram(tmp_path_factory):
    """A small unigram model with byte fallback, written out by hand."""
    model = sentencepiece_model_pb2.ModelProto()
    add = lambda piece, score, kind: model.pieces.add(piece=piece, score=score, type=kind)
    for piece, kind in (("<unk>", 2), ("<s>", 3), ("</s>", 3)):
        add(piece, 0.0, kind)
    for k in range(256):
        add(f"<0x{k:02X}>", 0.0, 6)
    for k, piece in enumerate(["▁", "a", "b", "ab", "▁a", "▁ab", "ba", "aba", "é", "▁é", "abab"]):
        add(piece, -1.0 - k * 0.37, 1)
    model.trainer_spec.model_type, model.trainer_spec.byte_fallback, model.trainer_spec.unk_id = 1, True, 0
    spec = model.normalizer_spec
    spec.name, spec.add_dummy_prefix, spec.remove_extra_whitespaces, spec.escape_whitespaces = "identity", True, False, True
    path = tmp_path_factory.mktemp("model") / "unigram.model"
    path.write_bytes(model.SerializeToString())
    return str(path)


def test_unigram_model_with_byte_fallback(spark, unigram):
    r = random.Random(21)
    texts = ["", "abab", "é☃ b", "日本 ab", "☃☃", " a  b "] + ["".join(r.choice("aabbé☃ 😀") for _ in range(r.randint(0, 25))) for _ in range(300)]
    codec, processor = pieces.Codec(unigram), sentencepiece.SentencePieceProcessor(model_file=unigram)
    ids, n, parity, restored = codec.encode(texts)
    assert [ids[b - k : b].tolist() for b, k in zip(np.cumsum(n), n, strict=True)] == processor.encode(texts)
    assert parity.all() and restored.all()
    words = [" ".join(t.split()) for t in texts]
    docs = spark.createDataFrame(list(enumerate(words)), "doc_id long, text string")
    counts = {x["doc_id"]: x["n_tokens"] for x in tokencounts.token_counts(docs, unigram).collect()}
    assert [counts[i] for i in range(len(words))] == [sum(len(processor.encode(w)) for w in t.split()) for t in words]


def test_uncovered_characters_count_as_bytes():
    path = public_tokenizers.path("piece_bpe_32k.model")
    assert tokencounts.counted(pa.array(["𓀀" * 50]), *tokencounts.trie(path))[1].tolist() == [201] == [len(sentencepiece.SentencePieceProcessor(model_file=path).encode("𓀀" * 50))]


def test_sentencepiece_forgets_without_change(monkeypatch):
    monkeypatch.setattr(pieces, "REMEMBERED", 10)
    codec = pieces.Codec(public_tokenizers.path("piece_bpe_32k.model"))
    first = [x.tolist() for x in codec.encode(["some words of a text"] * 3 + ["other words"])]
    codec.encode([" ".join(f"w{k}" for k in range(50))])
    assert [x.tolist() for x in codec.encode(["some words of a text"] * 3 + ["other words"])] == first


def test_sentencepiece_edges(spark, odd, empty):
    rows = pieces.encoded(odd).collect()
    assert len(rows) == odd.count() and all(r["parity"] and r["restored"] for r in rows)
    assert all(r["n_tokens"] == 0 for r in rows if r["doc_id"] in (5, 6))
    texts = {r["doc_id"]: r["text"] for r in pieces.decoded(pieces.encoded(odd.where("doc_id = 12"))).collect()}
    assert texts[12] == "日本語 ☃ 😀 é  ü"
    assert pieces.encoded(empty).count() == 0


def test_canonical_json_and_schemas():
    assert chat.canonical({"b": 1.0, "a": [True, None, "é"], "c": {"z": 0.5, "y": {}}}) == '{"a":[true,null,"é"],"b":1,"c":{"y":{},"z":0.5}}'
    schema = chat.SCHEMAS["summarise"]
    assert chat.violations({"turn": 1, "max_chars": 50}, schema) == []
    assert chat.violations({"turn": -1, "max_chars": 5}, schema) == ["$.max_chars: too small", "$.turn: too small"]
    assert chat.violations({"turn": True}, schema) == ["$.max_chars: missing", "$.turn: not of type integer"]
    assert chat.violations([1, "x"], {"type": "array", "items": {"type": "integer"}}) == ["$[1]: not of type integer"]


def test_tool_calls_are_linked_and_ordered(spark):
    calls = [(1, 1, "x", "search", '{"query": "q", "turn": 1}', ["y"]), (1, 3, "y", "nope", "{}", []), (1, 5, "x", "search", "not json", []), (1, 7, "l", "search", "{}", ["l"]), (2, 1, None, "search", None, None), (None, 1, "x", None, "{}", [])]
    results = [(1, 2, "x", "first"), (1, 6, "x", "second"), (1, 8, "q", "lost"), (None, 2, "x", "lost")]
    c = spark.createDataFrame(calls, "conv_id long, turn long, call_id string, name string, arguments string, after array<string>")
    r = spark.createDataFrame(results, "conv_id long, turn long, call_id string, content string")
    rows = chat.formatted(c, r, chat.SCHEMAS).collect()
    assert len(rows) == 8
    own = {(x["call_id"], json.loads(x["json"]).get("result", {}).get("content")): x for x in rows if x["conv_id"] == 1}
    assert own["x", "first"]["place"] == 1 and own["y", None]["place"] == 0 and own["x", "second"]["place"] == 2
    assert own["l", None]["place"] is None and own["q", "lost"]["status"] == "no_call" and own["q", "lost"]["valid"] is None
    assert own["x", "first"]["valid"] and own["x", "second"]["problems"] == "arguments are not JSON" and own["y", None]["problems"] == "unknown tool"
    large = {(x["call_id"], x["json"]): x["place"] for x in chat.formatted(c, r, chat.SCHEMAS, large=1).collect() if x["conv_id"] == 1}
    assert sorted(v for v in large.values() if v is not None) == [0, 1, 2]
    assert next(v for (k, _), v in large.items() if k == "l") is None


def test_large_conversations_have_the_order_of_small_ones(spark):
    r = random.Random(5)
    calls = [(1, 1, "a", ["b"]), (1, 3, "b", []), (1, 5, "c", [])]
    for conv in range(2, 8):
        n = 60
        for k in range(n):  # needs of earlier calls, of any, of itself, of missing ones
            needs = r.sample([f"c{j}" for j in range(k if conv < 4 else n)] + [f"m{conv}"] * (conv > 5), min(k, r.choice([0, 0, 1, 2])))
            calls.append((conv, r.choice([k, k, None, -5000 * k]) if conv > 4 else k, f"c{k if r.random() < 0.9 else r.randrange(n)}", needs))
    c = spark.createDataFrame(calls, "conv_id long, turn long, call_id string, after array<string>")
    c = c.select("*", F.lit("linked").alias("status"), F.row_number().over(Window.partitionBy("conv_id", "call_id").orderBy("turn", "after")).alias("use"))
    c.persist()
    small, large = ({(x["conv_id"], x["call_id"], x["use"]): x["place"] for x in chat.places(c, most).collect()} for most in (1000, 1))
    assert small == large and len(small) == len(calls)
    assert [small[1, x, 1] for x in "bac"] == [0, 1, 2]


def test_chains_longer_than_a_large_conversation(spark):
    n = 3 * chat.LARGE
    c = spark.range(n).select(F.lit("z").alias("conv_id"), F.col("id").alias("turn"), F.col("id").cast("string").alias("call_id"), F.lit(1).alias("use"), F.lit("linked").alias("status"))
    other = lambda k: F.array((F.col("turn") + k).cast("string"))
    for after, place in ((F.when(F.col("turn") > 1, other(-2)), F.col("turn")), (F.when(F.col("turn") < n - 1, other(1)), n - 1 - F.col("turn")), (other(-1), F.lit(None).cast("long"))):
        rows = chat.places(c.withColumn("after", after)).join(c, "call_id")
        assert rows.count() == n and rows.where(~F.col("place").eqNullSafe(place)).isEmpty()


def test_derived_calls_and_empty_conversations(spark):
    turns = spark.createDataFrame([(1, 0, "user", "hi"), (1, 1, "assistant", "yes. no"), (1, 2, "user", None), (1, 3, "assistant", None), (None, None, None, None)], "conv_id long, turn long, role string, text string")
    assert chat.formatted(*chat.derived(turns), chat.SCHEMAS).count() == 2
    assert chat.formatted(*chat.derived(turns.limit(0)), chat.SCHEMAS).count() == 0


def test_chat_rows_hold_all_text_of_conversations(spark, tmp_path):
    # turns 4, 5, 6 choose each of the tools
    turns = [(1, 0, "system", "be brief."), (1, 1, "user", "one. two"), (2, 0, "user", "opening. words"), (None, None, None, "stray \ud83d\ude00".encode("utf-16", "surrogatepass").decode("utf-16"))]
    turns += [(c, k, "assistant", f"a{c}{k}. more \"{k}\"\n end.") for c, k in ((1, 2), (1, 4), (1, 6), (1, 7), (2, 1))] + [(1, 3, "user", "b. c"), (1, 5, "tool", "d. e"), (2, 2, "user", None)]
    spark.createDataFrame(turns, "conv_id long, turn long, role string, text string").write.parquet(str(tmp_path / "conversations.parquet"))
    rows = queries.QUERIES["op5_chat_formatting"](spark, str(tmp_path)).collect()
    held = []
    for x in rows:
        body = json.loads(x["json"])
        found = [body[k].get("content") for k in ("message", "result") if k in body]
        if "call" in body:
            found += [body["call"]["arguments"][k] for k in ("query", "text") if k in body["call"]["arguments"]]
        held += [(x["conv_id"], t) for t in found if t is not None]
    assert sorted(held, key=str) == sorted([(t[0], t[3]) for t in turns if t[3] is not None], key=str)
    assert {json.loads(x["json"])["message"]["turn"] for x in rows if x["status"] == "message"} == {0, 5, None}


def test_trie_counts_equal_unigram_model():
    scores = tokencounts.piece_scores(public_tokenizers.path("piece_bpe_32k.model"))
    model = Tokenizer(models.Unigram([("<unk>", 0.0), *scores.items()], unk_id=0))
    planted, r = tokencounts.Trie(scores), random.Random(8)
    for word in ["the", "thentionwhat", "☃☃", "日本語x", "é"] + ["".join(r.choice(["th", "e", "ing", "ß", "☃", "x", "and"]) for _ in range(r.randint(1, 12))) for _ in range(400)]:
        assert planted.count("▁" + word) == len(model.encode("▁" + word).ids), word
    nodes = len(planted.forward)
    planted.count("▁thention")
    assert len(planted.forward) == nodes  # a prefix that is there costs nothing


def test_token_count_edges(odd, empty):
    rows = tokencounts.token_counts(odd).collect()
    assert len(rows) == odd.count() and all(r["n_tokens"] == 0 for r in rows if r["doc_id"] in (5, 6, 7))
    assert next(r for r in rows if r["doc_id"] == 10)["n_words"] == 60_000
    assert tokencounts.token_counts(empty).count() == 0


def test_elias_fano_select():
    r = np.random.default_rng(9)
    for ends in (np.zeros(0, int), np.array([0]), np.array([7]), np.zeros(300, int), np.cumsum(r.integers(0, 3000, 700)), np.cumsum(r.integers(0, 2, 700))):
        low, upper, directory, lower = tokenfiles.elias_fano(ends)
        coded = tokenfiles.Boundaries(len(ends), low, upper, directory, lower)
        assert coded.all().tolist() == ends.tolist()
        assert [coded.select(k) for k in range(len(ends))] == ends.tolist()


def test_token_files_round_trip(spark, odd, empty, tmp_path):
    tokenizer = Tokenizer.from_file(public_tokenizers.path("byte_bpe_50k.json"))
    tokenizer.encode_special_tokens = True
    rows = tokenfiles.token_files(odd, f"{tmp_path}/tokens").collect()
    texts = sorted(((r["doc_id"] is not None, r["doc_id"] or 0, r["text"] or "") for r in odd.collect()))
    start = 0
    for row, (_, _, text) in zip(sorted(rows, key=lambda r: r["start"]), texts, strict=True):
        ids = np.array([*tokenizer.encode(text, add_special_tokens=False).ids, 0], "<u4")
        assert (row["start"], row["n_tokens"], row["ids_crc32"]) == (start, len(ids), zlib.crc32(ids))
        start += len(ids)
    assert tokenfiles.token_files(empty, f"{tmp_path}/none").count() == 0


def test_pieces_of_texts_have_the_ids_of_whole_texts():
    path = public_tokenizers.path("byte_bpe_50k.json")
    tokenizer, encoder, r = Tokenizer.from_file(path), tokenfiles.Encoder(path), random.Random(10)
    tokenizer.encode_special_tokens = True
    parts = ["a", "don't", "é", " ", "  ", "\n", "\t", " ", " ", "　", ".", ",", "'s", "12", "☃", "«", "<|endoftext|>", "\x1c", "the"]
    texts = ["".join(r.choice(parts) for _ in range(r.randint(0, 15))) for _ in range(3000)]
    ids, n = encoder.encode(pa.chunked_array([texts]))
    for text, end, k in zip(texts, np.cumsum(n), n, strict=True):
        assert ids[end - k : end].tolist() == tokenizer.encode(text, add_special_tokens=False).ids, text


def linked_brute(vectors: np.ndarray, cosine: float) -> np.ndarray:
    unit = vectors / np.linalg.norm(vectors, axis=1, keepdims=True)
    near = unit @ unit.T >= cosine
    np.fill_diagonal(near, False)
    return near


@pytest.mark.parametrize("tile", [16, 2048])
def test_near_vectors_equal_all_pairs(spark, tile):
    r = np.random.default_rng(11)
    centres = r.normal(size=(30, 20))
    crowd = centres[:1] + r.normal(size=(120, 20)) * 0.12  # a third of all rows
    vectors = np.concatenate([r.normal(size=(80, 20)), np.repeat(centres, 5, axis=0) + r.normal(size=(150, 20)) * 0.25, crowd, np.repeat(centres[:1], 3, axis=0)])
    near = linked_brute(vectors, 0.95)
    rows = [(int(i), [float(x) for x in v]) for i, v in enumerate(vectors)]
    found = {r["vec_id"]: r for r in embeddings.near_vectors(spark.createDataFrame(rows, "vec_id long, embedding array<double>").repartition(4), tile=tile).collect()}
    root = np.arange(len(vectors))
    for _ in range(len(vectors)):
        new = np.array([min([root[i], *root[near[i]]]) for i in range(len(root))])
        if (new == root).all():
            break
        root = new
    for i in range(len(vectors)):
        assert (found[i]["n_links"], found[i]["component_id"], found[i]["kept"]) == (near[i].sum(), root[i], root[i] == i)


def links_of(rows, **settings):
    return {r["vec_id"]: (r["n_links"], r["component_id"]) for r in embeddings.near_vectors(rows.repartition(4), **settings).collect()}


def expected_links(vectors):
    near = linked_brute(vectors, 0.95)
    root = np.arange(len(vectors))
    while True:
        new = np.array([min([root[i], *root[near[i]]]) for i in range(len(root))])
        if (new == root).all():
            return {i: (int(near[i].sum()), int(root[i])) for i in range(len(vectors))}
        root = new


@pytest.mark.parametrize(("cell", "tile"), [(8, 4096), (8, 20), (64, 50)])
def test_near_vectors_in_many_cells(spark, cell, tile):
    r = np.random.default_rng(12)
    vectors = r.normal(size=(900, 19))
    vectors[300:600] = vectors[:300] + r.normal(size=(300, 19)) * 0.2  # on both sides of the threshold
    vectors[600:700] = vectors[0] + r.normal(size=(100, 19)) * 0.1
    rows = [(i, [float(x) for x in v]) for i, v in enumerate(vectors.astype(np.float32))]
    expected = expected_links(vectors.astype(np.float32).astype(np.float64))
    assert any(n == 0 for n, _ in expected.values()) and sum(n for n, _ in expected.values()) > 5000
    assert links_of(spark.createDataFrame(rows, "vec_id long, embedding array<float>"), cell=cell, tile=tile) == expected


def test_vectors_of_two_widths(spark):
    r = np.random.default_rng(13)
    rows = [(i, [1.0, 2.0, 3.0 + i / 100]) for i in range(5)] + [(9, [1.0, 2.0, 3.0, 0.0])] + [(20 + i, r.normal(size=4).tolist()) for i in range(3)]
    found = links_of(spark.createDataFrame(rows, "vec_id long, embedding array<double>"))
    assert all(found[i] == (4, 0) for i in range(5)) and found[9] == (0, 9)


def test_many_equal_vectors_are_compared_as_one(spark):
    r = np.random.default_rng(14)
    one = r.normal(size=16)
    rows = [(i, one.tolist()) for i in range(5000)] + [(5000 + i, (one + 0.01 * r.normal(size=16)).tolist()) for i in range(3)] + [(6000 + i, r.normal(size=16).tolist()) for i in range(50)]
    found = links_of(spark.createDataFrame(rows, "vec_id long, embedding array<double>"))
    assert all(found[i] == (5002, 0) for i in range(5003))
    assert sum(n for i, (n, _) in found.items() if i >= 6000) == 0


def test_first_step_compares_a_part_of_all_pairs():
    r = np.random.default_rng(15)
    turned = embeddings.unit(r.normal(size=(4000, 64)))
    block, budget = turned[:, :8], 0.1 / 8
    sent = sum(len(rows) for rows, *_ in embeddings.reached(block, 8, budget))
    assert sent < 20 * len(block)  # copies of a vector in a block, its own included, at the finest cut


def test_vector_edges(spark):
    rows = [(1, [1.0, 0.0], 1), (2, [2.0, 0.0], 1), (3, None, 1), (4, [], 1), (5, [0.0, 0.0], 1), (6, [float("nan"), 1.0], 1), (7, [1.0, None], 1), (8, [1e300, 1e300], 1), (9, [float("inf"), 0.0], 1), (10, [1.0], 1), (None, [1.0, 0.0], 1), (1, [1.0, 0.0], 2)]
    df = spark.createDataFrame(rows, "vec_id long, embedding array<double>, n_links int")
    found = {r["vec_id"]: (r["n_links"], r["component_id"]) for r in embeddings.near_vectors(df).collect()}
    assert found[1] == (1, 1) and found[2] == (1, 1) and all(found[k] == (0, k) for k in (3, 4, 5, 6, 7, 8, 9, 10, None))
    assert embeddings.near_vectors(df.limit(0)).count() == 0


def brute_components(texts: list, percent: int = 80) -> list[int]:
    lower, sets = str.maketrans("ABCDEFGHIJKLMNOPQRSTUVWXYZ", "abcdefghijklmnopqrstuvwxyz"), []
    for text in texts:
        words = WORD.findall((text or "").translate(lower))
        sets.append({tuple(words[i : i + 5]) for i in range(max(1, len(words) - 4))} if words else set())
    root = list(range(len(sets)))
    for i, a in enumerate(sets):
        for j in range(i):
            if a and sets[j] and 100 * len(a & sets[j]) >= percent * len(a | sets[j]):
                low, high = sorted((root[i], root[j]))
                root = [low if r == high else r for r in root]
    return root


def test_near_copies_equal_all_pairs(spark):
    r = random.Random(12)
    vocabulary = [f"w{k}" for k in range(400)]
    passage = r.choices(vocabulary, k=60)
    texts: list[str | None] = [None, "", " ", "one two", "ONE two", "a b c d e", "A b c d e"]
    for _ in range(25):
        base = r.choices(vocabulary, k=r.randint(8, 120))
        for _ in range(r.randint(1, 6)):
            words = list(base)
            for _ in range(r.randint(0, max(1, len(words) // 40))):
                words[r.randrange(len(words))] = r.choice(vocabulary)
            texts.append(" ".join(words + (passage if r.random() < 0.4 else [])))
    family = r.choices(vocabulary, k=150)  # a third of all rows, some of them only linked through others
    for k in range(50):
        words = list(family)
        for at in r.sample(range(150), k % 9):
            words[at] = r.choice(vocabulary)
        texts.append(" ".join(words))
    docs = spark.createDataFrame(list(enumerate(texts)), "doc_id long, text string").repartition(5)
    found = {x["doc_id"]: x["component_id"] for x in neighbours.near_copies(docs).collect()}
    assert [found[i] for i in range(len(texts))] == brute_components(texts)
    assert sorted(x["doc_id"] for x in neighbours.keep_one(docs).collect()) == sorted(set(brute_components(texts)))


def test_one_row_stays_also_where_ids_repeat_or_are_null(spark):
    a, b = "one two three four five six seven eight", "another text that has nothing in common with the first one at all"
    rows = [(1, a), (1, a), (None, a), (None, a), (1, b), (2, b), (None, b), (3, None), (3, None), (4, ""), (1, "a third text with some other words in it")]
    kept = neighbours.keep_one(spark.createDataFrame(rows, "doc_id long, text string").repartition(3)).collect()
    assert sorted(map(tuple, kept), key=str) == sorted([(1, a), (1, b), (3, None), (3, None), (4, ""), (1, "a third text with some other words in it")], key=str)
    nameless = neighbours.keep_one(spark.createDataFrame([(None, a), (None, a), (None, a + " nine")], "doc_id long, text string")).collect()
    assert len(nameless) == 1


def test_postings_are_made_and_shuffled_once(spark):
    docs = spark.createDataFrame([(1, "a b c d e f g")], "doc_id long, text string")
    sizes = spark.createDataFrame([(1, 3, 1)], "class long, n long, doc_id long")
    plan = neighbours.possible(docs, sizes, 80)._jdf.queryExecution().executedPlan().toString()
    assert plan.count("MapInArrow") == 1 and plan.count("hashpartitioning(shingle") == 1


def test_documents_are_chosen_alike_beyond_the_bound(spark, odd):
    ids = spark.createDataFrame([(1,), (12,), (99,)], "doc_id long")
    few, many = (sorted(map(str, neighbours.chosen(odd, ids, most).collect())) for most in (10, 0))
    assert few == many and len(few) == 4  # with the row without an id


def test_near_copies_of_eight_and_nine_words(spark):
    docs = spark.createDataFrame([(1, "a b c d e f g h"), (2, "a b c d e f g h i"), (3, "some other words that nothing else has here")], "doc_id long, text string")
    assert {x["doc_id"]: x["component_id"] for x in neighbours.near_copies(docs).collect()} == {1: 1, 2: 1, 3: 3}


@pytest.mark.parametrize("percent", [30, 50, 67, 80, 95])
def test_prefixes_meet_often_enough_for_all_sizes(percent):
    for c in range(1, 400 if percent >= 50 else 60):
        most = c * (100 - percent) // percent
        a, b = (x.ravel() for x in np.mgrid[: most + 1, : most + 1])
        a, b = a[a + b <= most], b[a + b <= most]
        n, m = c + a, c + b
        assert all(neighbours.linked(c, x, y, percent) for x, y in ((c, c + most), (c + most, c)))
        first, second = neighbours.prefix_sizes(n, percent), neighbours.prefix_sizes(m, percent)
        met = np.minimum(np.where(first == n, c, first - a), np.where(second == m, c, second - b))
        assert (met >= first - (n - neighbours.needed(n, percent))).all(), c


def test_divide_skip_equals_counting():
    r = np.random.default_rng(13)
    for _ in range(60):
        query = np.unique(r.integers(0, 200, r.integers(1, 80)))
        sets = [np.unique(np.concatenate([query[r.random(len(query)) < r.random()], r.integers(0, 200, 8)])) for _ in range(r.integers(1, 60))]
        want = [neighbours.linked(len(np.intersect1d(query, s)), len(query), len(s)) for s in sets]
        assert neighbours.divide_skip(query, sets, 80) == want


def test_near_copy_edges(odd, empty):
    rows = neighbours.near_copies(odd).collect()
    assert len(rows) == odd.count()
    found = {r["doc_id"]: (r["n_shingles"], r["component_id"]) for r in rows}
    assert found[1] == found[2] == found[3] == found[None] == (16, 1) and found[4] == (19, 1)
    assert found[5] == (0, 5) and found[6] == (0, 6) and found[7] == (0, 7) and found[8] == found[9] == (1, 8) and found[10] == (1, 10)
    assert neighbours.keep_one(odd).columns == odd.columns
    assert neighbours.near_copies(empty).count() == 0


def test_components_of_chains_and_hubs(spark):
    links = [(k, k + 1) for k in range(100, 160)] + [(1, k) for k in range(2, 90)] + [(200, 200), (300, 299)]
    found = {r["node"]: r["root"] for r in components(spark.createDataFrame(links, "a long, b long"), "test").collect()}
    assert all(found[k] == 100 for k in range(100, 161)) and all(found[k] == 1 for k in range(1, 90)) and found[300] == found[299] == 299


def test_common_short_texts_are_spread_over_parts(spark):
    """A third of all rows is one empty text: it gets a range of its own, and no part of it holds more than the others do."""
    texts = ["" if k % 3 == 0 else f"text number {k} " * (1 + k % 40) for k in range(9000)]
    narrow = sharding.keyed(spark.createDataFrame(list(enumerate(texts)), "doc_id long, text string"))
    total, count = narrow.agg(F.sum("size"), F.count("*")).first()
    key = narrow.where("size = 1").first()["key"] >> sharding.SHORT
    begins = sharding.bounds(*sharding.splitters(narrow, total, count))
    assert key in begins and key + 1 in begins
    per_shard = defaultdict(list)
    for x in sharding.shards(spark.createDataFrame(list(enumerate(texts)), "doc_id long, text string"), full=100).collect():
        per_shard[x["shard"]].append(x)
    assert all(sorted(x["slot"] for x in v) == list(range(len(v))) for v in per_shard.values())
    assert all(abs(sum(x["size"] for x in v) - total / 16) <= 2000 for v in per_shard.values())


def test_calls_with_infinite_numbers_broken_text_and_further_columns(spark):
    schemas = {"f": {"type": "object", "properties": {"n": {"type": "integer"}}}}
    calls = [(1, 0, "a", "f", '{"n": 1e999}', None, "x", 7), (1, 1, "b", "f", '{"s": "\\ud800"}', ["a"], "y", 8)]
    calls = spark.createDataFrame(calls, "conv_id long, turn int, call_id string, name string, arguments string, after array<string>, content string, place long")
    results = spark.createDataFrame([(1, 2, "a", "done", 5)], "conv_id long, turn int, call_id string, content string, status int")
    rows = {x["call_id"]: x.asDict() for x in chat.formatted(calls, results, schemas).collect()}
    assert len(rows) == 2 and chat.violations(json.loads('{"n": 1e999}'), schemas["f"]) == ["$.n: not of type integer"]
    assert chat.canonical(json.loads('"\\ud800"')) == '"�"' and chat.canonical(math.inf) == "null"


def test_ids_of_large_vocabularies_have_32_bits(spark, tmp_path):
    vocab = {f"w{k}": k for k in range(70_000)}
    tokenizer = Tokenizer(models.WordLevel(vocab, unk_token="w1"))
    tokenizer.save(f"{tmp_path}/words.json")
    manifest = tokenfiles.write_files(spark.createDataFrame([(1, "w69999")], "doc_id long, text string"), f"{tmp_path}/files", f"{tmp_path}/words.json")
    with open(manifest.first()["path"], "rb") as f:
        assert tokenfiles.unpacked(f.read())[2].tolist() == [69_999, 0]


def test_islands_begin_at_a_blank():
    text = "x" * 90 + " (at) example.com"
    assert next(personal.islands(text, []))[0][0] == 0


def test_caches_keep_what_is_met_often(monkeypatch):
    """They used to start anew, so that common pieces were encoded again and again."""
    monkeypatch.setattr(pieces, "REMEMBERED", 6)
    monkeypatch.setattr(tokenfiles, "REMEMBERED", 6)
    codec = pieces.Codec(public_tokenizers.path("piece_bpe_32k.model"))
    path = public_tokenizers.path("byte_bpe_50k.json")
    encoder, plain = tokenfiles.Encoder(path), Tokenizer.from_file(path)
    for i in range(20):
        text = f"common word x{i} y{i}"
        ids, n, parity, restored = codec.encode([text])
        assert codec.decode(ids.tolist()) == text and parity.all() and restored.all()
        ids, n = encoder.encode(pa.chunked_array([[text, ""]]))
        assert ids.tolist() == plain.encode(text, add_special_tokens=False).ids and n.tolist() == [len(ids), 0]
        if i % 3 == 2:  # else nothing has been met twice
            codec.forget_rare()
            encoder.forget_rare()
            assert len(codec.known) <= 3 and sum("word" in x or "common" in x for x in codec.known) == 2
            assert len(encoder.known) <= 3 and sum("word" in x or "common" in x for x in encoder.known) == 2


@pytest.mark.parametrize("cached, model", [(pieces.codec, "piece_bpe_32k.model"), (tokenfiles.encoder, "byte_bpe_50k.json")])
def test_workers_encode_on_one_thread(monkeypatch, cached, model):
    """They used to start a thread for each core in each worker, all waiting for little work."""
    monkeypatch.setenv("TOKENIZERS_PARALLELISM", "true")
    cached.__wrapped__(public_tokenizers.path(model))
    assert os.environ["TOKENIZERS_PARALLELISM"] == "true"  # the caller's choice holds
    monkeypatch.delenv("TOKENIZERS_PARALLELISM")
    cached.__wrapped__(public_tokenizers.path(model))
    assert os.environ["TOKENIZERS_PARALLELISM"] == "false"


def test_parts_without_parity_are_told():
    codec = pieces.Codec(public_tokenizers.path("piece_bpe_32k.model"))
    codec.tokenizer = Tokenizer(models.WordLevel({"<unk>": 0, " known": 1, "▁": 2}, unk_token="<unk>"))
    texts = ["known", "other", "▁", "known other", ""]
    *_, parity, restored = codec.encode(texts)
    assert parity.tolist() == [False, False, False, False, True] and not restored[1] and not restored[3] and restored[4]
