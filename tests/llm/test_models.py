"""Encoding, language ID, packing, URL filter: exact round trips, held-out accuracy, laws, and defined cases."""

import math
import zlib

import numpy as np
import public_tokenizers
import pyarrow as pa
import pytest
from corpus_helpers import ROWS, SMALL, edge, empty
from pyspark.sql import functions as F

from funnelwright.llm import charlm, langid, packing, pieces, urls
from funnelwright.llm.tokens import WordTokenizer

PIECES, WORDS = public_tokenizers.path("piece_bpe_32k.model"), public_tokenizers.path("word_bpe_49k.json")
TEXTS = ["", " ", "  a  b ", "a\nb\n\n c", "日本語 テキスト 😀", "<s> </s> <0x0A> <unk>", "é" * 50, " lead", "trail  ", *[r[1] for r in ROWS if r[1]]]


@pytest.fixture(scope="module")
def sample(spark):
    return [r[0] for r in spark.read.parquet(f"{SMALL}/documents.parquet").select("text").collect()] + TEXTS


def test_without_dropout_ids_are_those_of_the_library(sample):
    from sentencepiece import SentencePieceProcessor

    own, library = pieces.piece_model(PIECES), SentencePieceProcessor(model_file=PIECES)
    plain = [t for t in sample if "▁" not in t]
    got = own.encode(plain, np.arange(len(plain), dtype=np.uint64), 1, 0.0, 4)
    assert [x.tolist() for x in got] == library.encode(plain)


@pytest.mark.parametrize("rate", [0.0, 0.1, 0.5, 1.0])
def test_every_cut_decodes_to_its_text(sample, rate):
    own = pieces.PieceModel(PIECES)
    texts = [*sample[-30:], "x▁y", "▁ ▁"]
    ids = own.encode(texts, np.arange(len(texts), dtype=np.uint64), 1, rate, 8)
    assert [own.decode(x.tolist()) for x in ids] == texts
    if rate == 1:  # nothing is merged: one piece for each character, and bytes
        assert all(len(x) >= len(t) for x, t in zip(ids, texts))


def test_dropout_varies_with_seed_and_key_and_repeats_itself():
    own, text = pieces.PieceModel(PIECES), "international segmentation of unbelievable sentences " * 4
    a, b, again = own.encode([text] * 3, np.array([1, 2, 1], np.uint64), 7, 0.2, 8)
    (other,) = pieces.PieceModel(PIECES).encode([text], np.array([1], np.uint64), 8, 0.2, 8)
    assert a.tolist() == again.tolist() and a.tolist() != b.tolist() and a.tolist() != other.tolist()
    plain = own.encode([text], np.array([1], np.uint64), 7, 0.0, 1)[0]
    assert len(a) > len(plain)


def _agenda(own, unit, variant, seed, rate):
    """The same cut, one candidate at a time."""
    from funnelwright.llm.common import mix

    u = np.uint64
    key = mix(np.array([variant], np.uint64) * pieces._MUL + u(seed))
    for c in unit:
        key = mix(key ^ u(ord(c)))
    parts = [(i, i + 1, own.symbols.get(c, -1)) for i, c in enumerate(unit)]
    while True:
        best = None
        for i, (left, right) in enumerate(zip(parts, parts[1:])):
            piece = int(own.merged(np.array([left[2]]), np.array([right[2]]))[0])
            place = mix(np.array([(left[0] << 42) | (right[0] << 21) | right[1]], np.uint64))
            if piece >= 0 and not (rate and int(mix(key ^ place)[0]) < rate * (2**64 - 1)):
                if best is None or own.rank[piece] < own.rank[best[1]]:
                    best = (i, piece)
        if best is None:
            return [p[2] for p in parts]
        i, piece = best
        parts[i : i + 2] = [(parts[i][0], parts[i + 1][1], piece)]


@pytest.mark.parametrize("together", [1, 1000])
def test_rounds_and_heap_equal_the_agenda(monkeypatch, together):
    own = pieces.PieceModel(PIECES)
    monkeypatch.setattr(pieces, "TOGETHER", together)
    units = [" " + w for w in "international the segmentation unbelievable a of mississippi zzzzzz ineffable".split()]
    for variant in range(4):
        got = own.cut(units, np.full(len(units), variant), 3, 0.3)
        assert [np.frombuffer(x, np.int32).tolist() for x in got] == [_agenda(own, w, variant, 3, 0.3) for w in units]


def test_a_unit_without_end_is_cut_by_the_heap():
    from sentencepiece import SentencePieceProcessor

    own, text = pieces.PieceModel(PIECES), "internationalsegmentation" * 4000
    plain = own.encode([text], np.zeros(1, np.uint64), 1, 0.0, 1)[0]
    assert plain.tolist() == SentencePieceProcessor(model_file=PIECES).encode(text)
    cut = own.encode([text], np.zeros(1, np.uint64), 1, 0.1, 8)[0]
    assert own.decode(cut.tolist()) == text and len(cut) > len(plain)


def test_merge_table_finds_every_merge_and_no_other():
    own = pieces.PieceModel(PIECES)
    pairs = np.array(list(own.pairs), np.int64)
    left, right = (x.astype(np.int32) for x in np.divmod(pairs, own.size))
    assert own.merged(left, right).tolist() == list(own.pairs.values())
    rng = np.random.default_rng(5)
    left, right = rng.integers(-2, own.size, (2, 20_000)).astype(np.int32)
    expected = [own.pairs.get(a * own.size + b, -1) if a >= 0 and b >= 0 else -1 for a, b in zip(left.tolist(), right.tolist())]
    assert own.merged(left, right).tolist() == expected


def test_lists_of_ids_are_decoded_together(sample):
    own = pieces.PieceModel(PIECES)
    ids = own.encode([*sample, None], np.arange(len(sample) + 1, dtype=np.uint64), 1, 0.2, 8)
    rows = pa.array([None if x is None else x.tolist() for x in ids], pa.list_(pa.int32()))
    assert own.decode_all(rows).to_pylist() == [*sample, None]
    assert own.decode_all(rows.slice(len(sample) - 3)).to_pylist() == [*sample[-3:], None]
    half = own.byte_ids["é".encode()[0]]  # no character by itself
    odd = [[half], [], [*ids[len(sample) - 1].tolist(), half], [own.byte_ids[32], half]]
    assert own.decode_all(pa.array(odd, pa.list_(pa.int32()))).to_pylist() == [own.decode(x) for x in odd]
    assert own.decode_all(pa.array([], pa.list_(pa.int32()))).to_pylist() == []


def test_encoding_on_edge_rows(edge, empty):
    out = pieces.encode(edge, PIECES)
    assert out.columns[-1] == "_ids"
    back = out.select("text", pieces.decoded(F.col("_ids"), PIECES).alias("back")).collect()
    assert len(back) == len(ROWS) and all(r.text == r.back for r in back)
    assert pieces.encode(empty, PIECES).count() == 0


LEARNED = [("a", "abracadabra alakazam Abra"), ("a", "banana band"), ("b", "zyx zyx xyz"), ("b", "日本語 日本 語")]


@pytest.mark.parametrize("entries", [None, 1 << 21, 100, 0])
@pytest.mark.parametrize("smoothing", ["kneser-ney", "witten-bell"])
def test_models_give_probabilities(spark, smoothing, entries):
    df = spark.createDataFrame(LEARNED, "class string, text string")
    model = charlm.fit(df, "letters", smoothing, ["a", "b"], entries)
    for before in ("brac", "日本語 ", "qqqq"):
        context = charlm.grams(pa.array([before]), model.alphabet)[0][-1:] << np.uint64(charlm.SYMBOL_BITS) & np.uint64((1 << 60) - 1)
        every = context | np.arange(charlm.SYMBOLS, dtype=np.uint64)
        assert np.allclose(np.exp(model.score(every).astype(np.float64)).sum(axis=0), 1, atol=2e-3), before
    if entries != 0:
        (sums, _) = charlm.totals(model, pa.array(["abra", "zyx"]))
        assert sums[0, 0] > sums[0, 1] and sums[1, 1] > sums[1, 0]


def _plain_model(texts, smoothing):
    """Probability of a character after a context, straight from the definitions, over strings."""
    counts = [{} for _ in range(charlm.ORDER + 1)]
    for text in texts:
        padded = "\x01" * (charlm.ORDER - 1) + text
        for i in range(len(text)):
            gram = padded[i : i + charlm.ORDER]
            counts[charlm.ORDER][gram] = counts[charlm.ORDER].get(gram, 0) + 1
    for order in range(charlm.ORDER - 1, 0, -1):
        for gram, c in counts[order + 1].items():
            counts[order][gram[1:]] = counts[order].get(gram[1:], 0) + (1 if smoothing == "kneser-ney" else c)

    def probability(gram):
        if not gram:
            return 1 / charlm.SYMBOLS
        level = counts[len(gram)]
        followers = [c for g, c in level.items() if g[:-1] == gram[:-1]]
        lower = probability(gram[1:])
        if not followers:
            return lower
        total, types, c = sum(followers), len(followers), level.get(gram, 0)
        if smoothing == "witten-bell":
            return (c + types * lower) / (total + types)
        n1, n2 = (sum(x == n for x in level.values()) for n in (1, 2))
        d = min(0.95, max(0.05, n1 / (n1 + 2 * n2) if n1 + n2 else 0.5))
        return (max(c - d, 0) + d * types * lower) / total

    return probability


@pytest.mark.parametrize("smoothing", ["kneser-ney", "witten-bell"])
def test_models_equal_their_definitions(spark, smoothing):
    rows = [(c, t.lower().replace(" ", "\x01")) for c, t in LEARNED]
    model = charlm.fit(spark.createDataFrame(LEARNED, "class string, text string"), "letters", smoothing, ["a", "b"], None)
    judged = ["abra", "bandana", "xyzzy", "日本", "zqz", "a語", "band zyx alakazam"]
    sums, sizes = charlm.totals(model, pa.array(judged))
    for i, name in enumerate(["a", "b"]):
        probability = _plain_model([t for c, t in rows if c == name], smoothing)
        for text, found in zip(judged, sums[:, i], strict=True):
            padded = "\x01" * (charlm.ORDER - 1) + text.replace(" ", "\x01")
            wanted = sum(math.log(probability(padded[k : k + charlm.ORDER])) for k in range(len(text)))
            assert abs(found - wanted) < 1e-4 * max(1, len(text)), (name, text)
    assert sizes.tolist() == [len(t) for t in judged]


@pytest.mark.parametrize("entries", [0, 20, 1 << 21])
@pytest.mark.parametrize("smoothing", ["kneser-ney", "witten-bell"])
def test_a_model_larger_than_a_broadcast_loses_no_gram(spark, smoothing, entries):
    df = spark.createDataFrame(LEARNED, "class string, text string")
    plain = charlm.fit(df, "letters", smoothing, ["a", "b"], None)
    whole = charlm.fit_whole(df, "letters", smoothing, ["a", "b"], entries)
    assert isinstance(whole, charlm.Model if entries > 1000 else charlm.Tables)
    judged = ["abra", "bandana band", None, "", "xyzzy", "日本", "zqz", "a語", "band zyx alakazam", "abra"]
    sums, sizes = charlm.totals(plain, pa.array(judged))
    if isinstance(whole, charlm.Tables):
        rows = spark.createDataFrame(list(enumerate(judged)), "uid int, more string").repartition(3)
        out = whole.add_totals(rows, "more", "t").orderBy("uid").collect()
        assert [r.more for r in out] == judged and [r.t.chars for r in out] == sizes.tolist()
        assert np.allclose([r.t.sums for r in out], sums, rtol=1e-5, atol=1e-4)
    else:
        assert np.array_equal(charlm.totals(whole, pa.array(judged))[0], sums)


def test_urls_are_judged_by_all_grams_whatever_the_broadcast_holds(spark):
    given = [f"http://{h}.{t}/{p}/{i}" for i in range(12) for h in ("alpha", "www.beta") for t, p in (("com", "x"), ("net", "es"), ("org", "y"))] + [None, ""]
    rows = spark.createDataFrame(list(enumerate(given)), "page_id int, url string")
    columns = ["page_id", "rule", "ratio", "verdict"]
    want = urls.judge(rows, entries=None).orderBy("page_id").select(columns).collect()
    got = urls.judge(rows, entries=50).orderBy("page_id").select(columns).collect()
    assert [(r.page_id, r.rule, r.verdict) for r in got] == [(r.page_id, r.rule, r.verdict) for r in want]
    assert any(r.ratio for r in got)
    assert all((a.ratio is None) == (b.ratio is None) and abs((a.ratio or 0) - (b.ratio or 0)) < 1e-4 for a, b in zip(got, want, strict=True))


def test_frequent_characters_have_symbols_of_their_own(spark, monkeypatch):
    df = spark.createDataFrame([("ééa ba", "a"), ("b日", "a")], "text string, class string")
    whole = charlm.alphabet_of(df, "letters")
    assert [chr(p) for p in whole.points] == ["a", "b", "é", "日"]
    assert len(set(charlm._symbols(whole)[[ord(c) for c in "aBé日 語"]].tolist())) == 6
    monkeypatch.setattr(charlm, "SYMBOLS", 5)
    few = charlm.alphabet_of(df, "letters")
    assert [chr(p) for p in few.points] == ["a", "b"]
    assert charlm._symbols(few)[[ord(c) for c in "aBé日 1"]].tolist() == [3, 4, charlm.RARE, charlm.RARE, charlm.BLANK, charlm.BLANK]


def test_hash_array_finds_what_it_holds():
    keys = np.random.default_rng(1).integers(0, 1 << 60, 5000, dtype=np.uint64)
    keys = np.unique(keys)
    held = charlm.HashArray(keys[::2], np.arange(len(keys[::2])))
    assert (held.rows[held.find(keys[::2])] == np.arange(len(keys[::2]))).all() and (held.find(keys[1::2]) == -1).all()
    assert (charlm.HashArray(keys[:0], np.zeros(0)).find(keys[:9]) == -1).all()


@pytest.fixture(scope="module")
def detector(spark):
    from funnelwright.llm.catalog import fold

    docs = spark.read.parquet("/root/testdata/sf0.01/documents.parquet")
    return docs, langid.fit(docs, fold() > 1, fold() == 1)


def test_held_out_accuracy_and_rejection(spark, detector):
    from funnelwright.llm.catalog import fold

    docs, found = detector
    out = langid.detect(docs.where(fold() == 0), found)
    right, rejected, n = out.agg(F.avg((F.col("lang") == F.col("lang_pred")).cast("int")), F.sum(F.col("rejected").cast("int")), F.count("*")).first()
    assert right > 0.98 and rejected == 0 and n > 100
    junk = "".join(chr(97 + x) for x in np.random.default_rng(1).integers(0, 26, 600))
    out = langid.detect(spark.createDataFrame([(junk,), ("Ωμέγα " * 80,)], "text string"), found)
    assert all(r.rejected for r in out.collect())


def test_languages_on_edge_rows(spark, edge, empty, detector):
    out = langid.detect(edge, detector[1])
    assert out.columns[-1] == "_rejected" and out.columns[-3] == "_score"
    rows = out.collect()
    assert len(rows) == len(ROWS)
    none = [r for r in rows if not any(c.isalpha() for c in r.text or "")]
    assert len(none) == 4 and all(r.lang_pred == "und" and r._score == 0 and r._rejected for r in none)
    assert all(0 <= r._score <= 1 and r.lang_pred in ("de", "en", "es", "fr") for r in rows if r not in none)
    assert langid.detect(empty, detector[1]).count() == 0
    untaught = langid.fit(empty, F.lit(True), F.lit(True))
    assert {r.lang_pred for r in langid.detect(edge.drop("score"), untaught).collect()} == {"und"}


def test_word_by_word_ids_are_those_of_the_whole_text(sample):
    own = WordTokenizer(WORDS)
    for text in [*sample[:60], *TEXTS, "a<|endoftext|>b \x1c x\u2003y", "it's we'll 'S"]:
        want = own.tokenizer.encode(text, add_special_tokens=False).ids
        assert np.frombuffer(own.encode(text), "<u4").tolist() == want, text[:50]


def test_words_with_signs_are_put_together_from_both(sample):
    own = WordTokenizer(WORDS)
    texts = ["word, word. (Word) it's, x's. a-, -,. a1. é, ê... o'. we'll; abc<|endoftext|>, e\u0301, H\u0331.", "word", "word,", "K\u0338="]
    texts += [t[::-1] for t in sample[:20]]
    want = [own.tokenizer.encode(t, add_special_tokens=False).ids for t in texts]
    encoded, encode = [], own._cut
    own._cut = lambda words, letters: encoded.extend(words) or encode(words, letters)
    assert [np.frombuffer(x, "<u4").tolist() for x in own.encode_all(texts)] == want
    assert "word" in encoded and "word," not in encoded and "word." not in encoded and len(set(encoded)) == len(encoded)


def test_a_word_goes_to_the_tokenizer_once_in_any_case_and_batch():
    own = WordTokenizer(WORDS)
    many = [f"{a}{b}{c}{d}" for a in "abcdefgh" for b in "abcdefghijklmnopqrstuvwxyz" for c in "aeiou" for d in (*"bcdfghjklmnprst", "ñ", "1")]
    texts = ["Größe Word word WORD, word. GRÖSSE", None, "", " \t", " ".join(many[:9000]), " ".join(many[9000:]).upper(), "word " + " ".join(many)]
    encoded, encode = [], own._cut
    own._cut = lambda words, kind: encoded.extend(words) or encode(words, kind)
    want = [own.tokenizer.encode(t or "", add_special_tokens=False).ids for t in texts]
    for low, high in ((0, 5), (5, 7), (0, 7)):
        ids, ends = own.encode_column(pa.array(["x", *texts[low:high]]).slice(1))
        assert [ids[a:b].tolist() for a, b in zip(ends, ends[1:])] == want[low:high]
    assert len(set(encoded)) == len(encoded) and "word" in encoded and not {"Word", "WORD", "WORD,"} & set(encoded)


def test_words_that_made_way_are_known_or_learned_again(monkeypatch):
    monkeypatch.setattr("funnelwright.llm.tokens.CACHED", 3)
    own = WordTokenizer(WORDS)
    for text in ("one two three four, five", "six seven one", "eight nine ten four", "one two, 日本語 six", "five eight! one"):
        want = own.tokenizer.encode(text, add_special_tokens=False).ids
        assert np.frombuffer(own.encode(text), "<u4").tolist() == want
        assert len(set(own.new.words.to_pylist())) == len(own.new) <= 3 + 6


def test_a_worker_that_has_cut_its_rows_holds_no_words():
    rows = pa.RecordBatch.from_arrays([pa.array([1, 2]), pa.array(["some words, and more words", None])], ["id", "text"])
    assert sum(b.num_rows for b in packing._cut(iter([rows, rows]), WORDS, 4096, False)) == 4
    own = packing.word_tokenizer(WORDS)
    assert not own.new and not own.old


def _valid(out, size):
    used = {}
    for r in out:
        used.setdefault(r.sequence_id, []).append((r.offset, r.length))
    for spans in used.values():
        at = 0
        for offset, length in sorted(spans):
            assert offset == at
            at += length
        assert at <= size
    return len(used)


def test_packing_is_whole_and_tight(spark):
    rng = np.random.default_rng(1)
    lengths = rng.integers(1, 101, 5000).tolist() + [100] * 20
    df = spark.createDataFrame(list(enumerate(lengths)), "uid long, length long")
    out = packing.pack(df, size=100).join(df, "uid").collect()
    assert len(out) == len(lengths)
    assert _valid(out, 100) <= math.ceil(sum(lengths) / 100) * 1.01 + 2


def test_a_child_holds_every_piece_once_and_generations_help():
    rng = np.random.default_rng(2)
    lengths = rng.integers(20, 60, 300).astype(np.int64)
    first = [packing.best_fit(lengths, rng.permutation(300), 100) for _ in range(6)]
    child = packing.cross(lengths, first[0], first[1], 100, rng)
    assert child.min() == 0 and np.bincount(child, lengths).max() <= 100 and (np.bincount(child) > 0).all()
    best = packing.evolve(lengths, first, 100, 60, rng)[0]
    assert packing.quality(lengths, best, 100) < min(packing.quality(lengths, p, 100) for p in first)


def test_islands_exchange_guests(spark):
    """An instance that first packings cannot solve goes through all epochs and stays valid."""
    lengths = [int(x) for x in np.random.default_rng(3).integers(34, 51, 301)]
    df = spark.createDataFrame(list(enumerate(lengths)), "uid long, length long")
    out = packing.pack(df, size=100).join(df, "uid").collect()
    assert len(out) == 301 and _valid(out, 100) <= 151


def test_pieces_of_edge_rows(edge, empty):
    out = packing.pack_documents(edge, WORDS, size=64, with_ids=True).collect()
    _valid(out, 64)
    for doc_id, text, *_ in ROWS:
        want = WordTokenizer(WORDS).encode(text or "") + (1).to_bytes(4, "little")
        cuts = [(i // 256, i // 4, len(want[i : i + 256]) // 4, zlib.crc32(want[i : i + 256])) for i in range(0, len(want), 256)]
        got = [(r.piece, r.start, r.length, r.ids_crc32) for r in out if r.doc_id == doc_id]
        assert all(x in got for x in cuts)
    assert packing.pack_documents(empty, WORDS).count() == 0


def _rule(url):
    if url is None or "://" not in url:
        return "", "", None
    rest = url.split("://", 1)[1]
    end = min([rest.find(c) for c in "/?#" if c in rest] or [len(rest)])
    host, path = rest[:end], rest[end:]
    host = "".join(c.lower() if "A" <= c <= "Z" else c for c in host)
    path = path[: min([path.find(c) for c in "?#" if c in path] or [len(path)])]
    best = None
    for _, name, start in urls.RULES:
        if (host == name or host.endswith("." + name)) and path.startswith(start) and (best is None or len(name + start) > len(best)):
            best = name + start
    return host, path, best


def test_hosts_paths_and_rules_equal_brute_force(spark):
    given = [r[0] for r in spark.read.parquet(f"{SMALL}/pages.parquet").select("url").collect()]
    given += [None, "", "no scheme.com/", "http://", "HTTP://A.Example.COM/en/x", "http://com/", "x://notcom/en/", "http://www.example.com/en/?a://b.net/es/"]
    given += ["http://a.b?x/y#z", "http://É.com#/en/", "http://example.com/en", "http://x.net/es/\nline", "http://a.com://b.net/es/", "http://a.net/fr/"] * 2
    rows = spark.createDataFrame([(i, u, 1, 2) for i, u in enumerate(given)], "page_id int, url string, host int, verdict int")
    out = urls.judge(rows).orderBy("page_id").collect()
    assert [(r._host, r.path, r.rule) for r in out] == [_rule(u) for u in given]
    of = {n + s: v for v, n, s in urls.RULES}
    assert all(r._verdict == of[r.rule] for r in out if r.rule) and all(r._verdict in ("allow", "block") for r in out)


def test_the_models_repeat_the_rules_on_urls_they_have_not_seen(spark):
    pages = spark.read.parquet("/root/testdata/sf0.1/pages.parquet").select("url").distinct()
    ruled = pages.select("url", urls.rule_of(urls.host_of(F.col("url")), urls.path_of(F.col("url"))).verdict.alias("verdict")).where("verdict IS NOT NULL")
    fold = F.pmod(F.xxhash64("url"), F.lit(4))
    found = urls.fit(ruled.where(fold != 0))
    out = urls._scored(ruled.where(fold == 0), found.model, "url", "r")
    right = out.agg(F.avg(((F.col("r") >= found.threshold) == (F.col("verdict") == "allow")).cast("int"))).first()[0]
    assert right > 0.97


def test_urls_without_rules_or_rows(spark):
    plain = spark.createDataFrame([("http://a.org/x",), (None,)], "url string")
    assert {r.verdict for r in urls.judge(plain).collect()} == {"allow"}
    assert urls.judge(plain.limit(0)).count() == 0
