"""Extraction, token codes, language-model scores and language ID."""

import html
import math
import random
import re
import uuid
import zlib
from collections import Counter

import numpy as np
import pyarrow as pa
import pytest
from fixtures import documents, empty, table, words
from pyspark.sql import functions as F

from shoal.llm import html_extract, language_id, suffix_tree, token_codes
from shoal.llm.common import scratch_root


@pytest.fixture(scope="module")
def crf():
    return html_extract.trained()


def test_extraction_of_new_pages(crf):
    for family in html_extract.FAMILIES:
        precision, recall = html_extract.measured(crf, 40, 4242, (family,))
        assert precision > 0.97 and recall > 0.96, family


def test_extraction_of_a_family_that_was_never_seen():
    """The field is fitted without the layouts that it is held against: figures in the README."""
    for family in ("main", "nameless"):
        others = tuple(f for f in html_extract.FAMILIES if f != family)
        precision, recall = html_extract.measured(html_extract.trained(families=others), 60, 77, (family,))
        assert precision > 0.9 and recall > 0.85, family


TEXT = "Some words of a paragraph, and then some more of them to fill it. "
MENU = "<ul>" + "".join(f"<li><a href='/{i}'>Page {i}</a></li>" for i in range(6)) + "</ul>"


@pytest.mark.parametrize(
    ("page", "want"),
    [
        (f'<article><p title="a hidden gem">{TEXT * 3}</p></article>', TEXT * 3),
        (f"<article><div data-hidden><p>{TEXT * 3}</p></div></article>", TEXT * 3),
        (f'<article><p data-note="style=display:none">{TEXT * 2}</p></article>', TEXT * 2),
        (f"<article><p title='don't'>{TEXT * 2}</p><p>{TEXT}</p></article>", TEXT * 3),
        (f'<article><div class="x>{TEXT * 2}</div><p title="y">{TEXT}</p></article>', TEXT * 3),
        (f"<body><nav>{MENU}</nav><main><h1>A title</h1><p>{TEXT * 3}</p><p>{TEXT}</p></main><footer>&copy; us</footer></body>", "A title " + TEXT * 4),
        (f"<body><h1>A heading</h1><p>{TEXT * 3}</p><p>{TEXT * 2}</p></body>", "A heading " + TEXT * 5),
        (f'<body><div class="zq1"><h1>Heading</h1><p>{TEXT * 3}</p><p>{TEXT * 3}</p></div><div class="zq2">{MENU}</div></body>', "Heading " + TEXT * 6),
        ("<article><p>em\u2003space\u3000and\u00a0more words of a paragraph that is long enough.</p></article>", "em space and more words of a paragraph that is long enough."),
        (f"<article><p>Let <math><mi>x</mi></math> be one. {TEXT}</p></article>", "Let x be one. " + TEXT),
        (f"<article><p hidden>gone</p><p style='color:red; display : none'>gone</p><div aria-hidden=true>gone</div><p>{TEXT}<script>if (a < b) x()</script></p></article>", TEXT),
        (f"<article><p>{TEXT}<a href='x' ", TEXT),
    ],
)
def test_extraction_of_ordinary_markup(crf, page, want):
    assert html_extract.main_text(crf, page) == " ".join(want.split())


def test_attributes_are_pairs():
    read = lambda tag: html_extract.attributes(tag, 2)[0]
    assert read("<a b=1 c='2 > 1' D=\"x &amp; y\" e = f g>") == [("b", "1"), ("c", "2 > 1"), ("d", "x & y"), ("e", "f"), ("g", "")]
    assert read("<a b='it's'>") == [("b", "it"), ("s'", "")] and read("<a b=\"x><i>") == [("b", "x")]
    assert html_extract.attributes("<a b/>c", 2)[1:] == (True, 6) and html_extract.attributes("<a b", 2)[2] > 4


def test_deep_and_long_pages_take_linear_time(crf):
    import time

    began = time.time()
    for page in ("<div>x" * 20_000, "<div class='a b'>" * 20_000 + "x", f"<article>{'<p>' + TEXT * 3:s}" + f"<p>{TEXT}" * 20_000, "</b>" * 20_000 + "<i>" * 20_000):
        html_extract.main_text(crf, page)
    assert time.time() - began < 60
    assert len(html_extract.main_text(crf, f"<article><h1>A title</h1><p>{TEXT * 20_000}</p></article>")) > 1_000_000


PROSE = "The river was high that spring and the old bridge stood in water up to its arches, so nobody crossed it for weeks."


@pytest.mark.parametrize(
    ("page", "want"),
    [
        (f"<html><head><title>t</title><body><article><p>{PROSE}</p></article>", PROSE),
        (f"<html><head><title>t</title><meta charset=utf-8><style>p {{}}</style><article><p>{PROSE}<p>{PROSE}</article>", f"{PROSE} {PROSE}"),
        (f"<article><p hidden>gone<h2>Shown</h2><p>{PROSE}</p></article>", f"Shown {PROSE}"),
        (f"<article><!--><p>{PROSE}</p><!---><p>{PROSE}</p><!-- <p>gone</p> --!></article>", f"{PROSE} {PROSE}"),
        (f'<article><p data-x="<b>bold</b>">{PROSE}</p></article>', PROSE),
        (f'<article><p>{PROSE} <a href="/x>here</a> and <a href="/y">there</a>.</p></article>', f"{PROSE} here and there."),
        (f"<article><p>{PROSE} The sign © marks it.</p></article>", f"{PROSE} The sign © marks it."),
        (f"<article><h1>Title<h2>Sub</h2><p>{PROSE}<table><tr><td>1<td>2</table>after the table it goes on for some words.</article>", f"Title Sub {PROSE} 1 2 after the table it goes on for some words."),
        (f"<html><head></head>Text before <article><p>{PROSE}</p></article></html>", None),
        (f"<body><article><h1>Bridge</h1><p>{PROSE}</p><p>{PROSE}</p></article><section id=comments><h2>Comments</h2><b>Ann</b><div class=comment><p>I liked it very much, thanks.</p></div></section></body>", f"Bridge {PROSE} {PROSE}"),
    ],
)
def test_extraction_by_the_rules_of_html(crf, page, want):
    """Left-out end tags, empty comments, quotes, the copyright sign in prose and comments with a heading."""
    got = html_extract.main_text(crf, page)
    assert got == want if want is not None else PROSE in got


def test_extraction_of_the_table(spark, sf, crf):
    pages = spark.read.parquet(f"{sf}/pages.parquet")
    got = {r.page_id: r for r in html_extract.extract(pages, crf).collect()}
    for p in pages.collect():
        body = re.search(r"<article>(.*?)(</article>|$)", p.html, re.S)[1]
        parts = [re.sub(r"\s+", " ", html.unescape(re.sub(r"<[^>]+>", "", x))).strip() for x in re.split(r"</?(?:p|h1|br)>", body)]
        assert got[p.page_id].text == " ".join(x for x in parts if x) and got[p.page_id].n_chars == len(got[p.page_id].text)


def test_extraction_of_odd_pages(spark, crf):
    pages = [(1, None), (2, ""), (3, "<"), (4, "<article><p>A &amp; b&nbsp;c <i>d</i>e.<script>x('<p>')</script><!-- n --><p>Next one"), (4, "<article><p>same"), (None, "<p")]
    df = spark.createDataFrame([(i, "u", h, "clash") for i, h in pages], "page_id long, url string, html string, text string")
    got = html_extract.extract(df, crf).collect()
    assert [r.text for r in got if r.page_id in (1, 2, None)] == ["", "", ""]
    assert sorted(r.text for r in got if r.page_id == 4) == ["A & b c de. Next one", "same"]
    assert html_extract.extract(df.where("false"), crf).count() == 0


def test_codes_give_every_id_directly():
    rng = np.random.default_rng(1)
    for ids in ([], [1], [2**31], range(512), range(1024), rng.integers(0, 49408, 3000), [3] * 700 + [70000] * 700):
        ids = np.array(list(ids), np.uint32)
        codes = token_codes.DirectCodes(token_codes.DirectCodes.encode(ids))
        assert len(codes) == len(ids) and list(codes.all()) == list(ids)
        assert all(codes[i] == ids[i] for i in range(len(ids)))
    with pytest.raises(IndexError):
        codes[len(ids)]


def test_token_files(spark):
    P = pytest.importorskip("public_tokenizers")
    from tokenizers import Tokenizer

    tokenizer = Tokenizer.from_file(P.path("word_bpe_49k.json"))
    rows = documents() + [(951, "<|ENDOFTEXT|>", None, None, 1, "", "", ""), (952, "a<|EndOfText|>b Cd <|startoftext|>", None, None, 1, "", "", "")]
    rows += [(950, "don't <|endoftext|>a b İSTANBUL é x́ \x01 y 😀 ﬁ 각 WE'LL", None, None, 1, "", "", "")]
    path = f"{scratch_root(spark)}/tokens-{uuid.uuid4().hex}"
    token_codes.write_tokens(table(spark, rows), path, P.path("word_bpe_49k.json"))
    got = sorted(token_codes.listed(spark, path).collect(), key=lambda r: r.start)
    start = 0
    for (d, text), r in zip(sorted(((r[0], r[1]) for r in rows), key=lambda x: (x[0] is not None, x[0] or 0, x[1] or "")), got, strict=True):
        ids = np.array([*tokenizer.encode(text or "", add_special_tokens=False).ids, 2], "<u4")
        assert (r.doc_id, r.start, r.n_tokens, r.ids_crc32) == (d, start, len(ids), zlib.crc32(ids.tobytes()))
        start += len(ids)
    ids = [i for t in (r[1] for r in sorted(rows, key=lambda r: (r[0] is not None, r[0] or 0))) for i in [*tokenizer.encode(t or "", add_special_tokens=False).ids, 2]]
    at = [0, 1, 17, len(ids) // 2, len(ids) - 1, len(ids), 10**12]
    assert {r["at"]: r["id"] for r in token_codes.tokens_at(spark, path, at).collect()} == {i: ids[i] for i in at if i < len(ids)}
    none = path + "-none"
    token_codes.write_tokens(empty(spark), none, P.path("word_bpe_49k.json"))
    assert token_codes.listed(spark, none).count() == 0


def test_encoder_equals_the_library():
    P = pytest.importorskip("public_tokenizers")
    from tokenizers import Tokenizer

    rng = random.Random(6)
    bits = ["<|endoftext|>", "<|ENDOFTEXT|>", "<|StartOfText|>", "<|", "|>", " ", "\n", "\u3000", "\u00a0", "\u0085", "Ab", "İ", "ǅ", "é", "ﬁ", "x\u0301", "don't", "WE'LL", "12", "!!", "😀", "각", "我", "\x01", "'s", "œUVRE", "a", "z?)"]
    texts = ["".join(rng.choice(bits) for _ in range(rng.randrange(12))) for _ in range(3000)] + [None, ""]
    for name in ("word_bpe_49k.json", "byte_bpe_50k.json"):
        library, own = Tokenizer.from_file(P.path(name)), token_codes.Encoder(P.path(name))
        assert own.by_words == own.direct == (name == "word_bpe_49k.json")
        want = [library.encode(t or "", add_special_tokens=False).ids for t in texts]
        for i in range(0, len(texts), 500):
            ids, n = own(texts[i : i + 500])
            assert n.tolist() == [len(w) for w in want[i : i + 500]] and ids.tolist() == [x for w in want[i : i + 500] for x in w]


def out_of_fold(i, n):
    return i is not None and zlib.crc32(str(i).encode()) % n == 1


def test_base_scores_and_counts(spark):
    rows = documents()
    counts = Counter()
    for r in rows:
        if not out_of_fold(r[0], 5):
            counts.update(words(r[1]) + ["\n"])
    total, norm = sum(counts.values()), sum(counts.values()) + 0.5 * (len(counts) + 1)
    want = Counter()
    for r in rows:
        own = words(r[1]) + ["\n"]
        want[r[0], out_of_fold(r[0], 5), len(own), sum(counts[w] > 0 for w in own), total, round(sum(math.log10((counts[w] + 0.5) / norm) for w in own), 4)] += 1
    got = suffix_tree.fold_scores(table(spark)).collect()
    assert Counter((r.doc_id, r.held_out, r.n_tokens, r.n_known, r.train_tokens, round(r.base_score, 4)) for r in got) == want
    assert all(r.score < 0 for r in got)
    assert suffix_tree.fold_scores(empty(spark)).count() == 0


def test_held_out_scores_beat_the_base(spark):
    got = suffix_tree.fold_scores(spark.read.parquet("/root/testdata/sf0.01/documents.parquet")).where("held_out").collect()
    assert sum(r.score for r in got) > sum(r.base_score for r in got)


def test_keys_are_those_of_spark(spark):
    from pyspark.sql import functions as F

    a, b = np.array([0, 1, -5, 2**62, 3589]), np.array([7, -1, 2**63 - 1, -(2**63), 3589])
    df = spark.createDataFrame([(int(x), int(y)) for x, y in zip(a, b, strict=True)], "c long, up long")
    want = [r[0] for r in df.select(F.xxhash64("c", "up")).collect()]
    assert suffix_tree.joined(a.view(np.uint64), b.view(np.uint64)).view(np.int64).tolist() == want


def plain_scores(rows, depth, evidence, diverge):
    """The same tree in dictionaries: contexts as tuples, at most one end before a text."""
    seqs = {d: [words(t) + ["\n"] for i, t in rows if (out_of_fold(i, 5)) == d] for d in (False, True)}
    uni = Counter(x for s in seqs[False] for x in s)
    norm = sum(uni.values()) + 0.5 * (len(uni) + 1)
    size = Counter({(x,): n for x, n in uni.items()})
    nexts = {}
    for s in seqs[False]:
        s = ["\n", *s]
        for t in range(1, len(s)):
            for d in range(1, min(depth, t) + 1):
                nexts.setdefault(tuple(s[t - d : t]), Counter())[s[t]] += 1
                size[tuple(s[t - d : t + 1])] += 1
    kept = {c: {x: n for x, n in v.items() if n >= evidence and (8 * n >= size[c] or n >= 16)} for c, v in nexts.items()}
    kept = {c: v for c, v in kept.items() if v}

    def p(c, x, stays=lambda c: True):
        if not c:
            return (uni[x] + 0.5) / norm
        below = p(c[1:], x, stays)
        if c not in kept or not stays(c):
            return below
        v = kept[c]
        return (max(v.get(x, 1) - 1, 0) + (size[c] - sum(n - 1 for n in v.values())) * below) / size[c]

    def nats(c):
        v = kept[c]
        rest = (size[c] - sum(n - 1 for n in v.values())) / size[c]
        return sum(n * math.log(p(c, x) / p(c[1:], x)) for x, n in v.items()) + (size[c] - sum(v.values())) * math.log(rest)

    stay = {c for c in kept if nats(c) >= diverge}
    stay |= {c[i:] for c in stay for i in range(1, len(c))}

    def score(s):
        s = ["\n", *s]
        return sum(math.log10(p(next((tuple(s[t - d : t]) for d in range(min(depth, t), 0, -1) if tuple(s[t - d : t]) in stay), ()), s[t], stay.__contains__)) for t in range(1, len(s)))

    return stay, sorted((i, round(score(words(t) + ["\n"]), 6)) for i, t in rows), p


def test_scores_equal_a_plain_tree(spark, monkeypatch):
    """Also of contexts that are rare words, twice among many; filters and heads of any size change nothing."""
    rng = np.random.default_rng(5)
    rare = ["zig zag zog zug end", "so zig zag zog zug end here", "but zig zag zog zag", "zig zag zog zug end"]
    texts = [" ".join(f"w{i}" for i in rng.zipf(1.3, rng.integers(0, 60)) % 40) for _ in range(150)] + rare * 2
    texts += [f"{a} same turn {b}" for a, b in (("left", "lost"), ("right", "won")) for _ in range(40)]  # three words tell
    rows = [(i, t) for i, t in enumerate(texts)] + [(7, texts[7])]
    stay, want, p = plain_scores(rows, 3, suffix_tree.EVIDENCE, suffix_tree.DIVERGE)
    _, of_two, _ = plain_scores(rows, suffix_tree.DEPTH, suffix_tree.EVIDENCE, suffix_tree.DIVERGE)
    assert any(c[-1].startswith("z") for c in stay) and {len(c) for c in stay} == {1, 2, 3}
    vocabulary = {x for i, t in rows if not out_of_fold(i, 5) for x in words(t)} | {"\n"}
    for c in [("same", "turn"), ("left", "same", "turn"), ("w1",)]:  # distributions sum to one, less what unknown words get
        assert sum(p(c, x) for x in vocabulary) == pytest.approx(1, abs=0.01)
    docs = spark.createDataFrame(rows, "doc_id long, text string").repartition(3)
    for bits, head in ((1 << 16, 1 << 20), (64, 60), (1 << 16, 0)):
        monkeypatch.setattr(suffix_tree, "FILTER_BITS", bits)
        monkeypatch.setattr(suffix_tree, "HEAD", head)
        held_out = F.pmod(F.crc32(F.col("doc_id").cast("string")), F.lit(5)) == 1
        got = suffix_tree.lm_scores(docs, held_out, depth=3) if head else suffix_tree.fold_scores(docs)
        assert sorted((r.doc_id, round(r.score, 6)) for r in got.collect()) == (want if head else of_two)


def test_texts_that_occur_twice_score_apart(spark):
    """What the corpus holds twice is better known than what it holds once, however rare its words are."""
    rng = random.Random(3)
    text = lambda: " ".join(rng.choice("bcdfg") + f"{int(rng.paretovariate(0.6)) % 5000}" for _ in range(80))
    once, twice = [text() for _ in range(200)], [text() for _ in range(20)] * 2
    rows = [(i, t) for i, t in enumerate(once + twice)]
    got = suffix_tree.lm_scores(spark.createDataFrame(rows, "doc_id long, text string"), F.lit(False)).collect()
    gain = {r.doc_id: (r.score - r.base_score) / r.n_tokens for r in got}
    assert sum(gain[i] for i in range(200, 240)) / 40 > 1.3 * sum(gain[i] for i in range(200)) / 200


def test_language_id(spark):
    docs = spark.read.parquet("/root/testdata/sf0.01/documents.parquet")
    lang = {r.doc_id: r.lang for r in docs.select("doc_id", "lang").collect()}
    held = language_id.identified(docs).where("held_out").collect()
    assert len(held) > 200 and sum(r.lang_pred == lang[r.doc_id] for r in held) / len(held) > 0.98
    assert all(0 <= r.score <= 1 for r in held)


def test_language_id_of_odd_rows(spark):
    got = language_id.identified(table(spark)).collect()
    by = {r.doc_id: r for r in got}
    assert len(got) == len(documents()) and all(by[i].lang_pred == "und" and by[i].score == 0 for i in (900, 901, 902, 904))
    assert by[905].lang_pred in ("en", "fr")
    assert language_id.identified(empty(spark)).count() == 0
    nothing = language_id.language_id(table(spark), language_id.train(empty(spark)))
    assert {r.lang_pred for r in nothing.collect()} == {"und"}


def plain_grams(text):
    """The n-grams of a text, one for each place and one for each word of a letter."""
    low = "".join(c if c.isalpha() else " " for c in (text or "").lower()).split()
    if not low:
        return []
    s = f" {' '.join(low)} "
    return [s[i : i + 4] for i in range(len(s) - 3)] + [f" {w} alone" for w in low if len(w) == 1]


def test_language_id_equals_plain_counts(spark):
    """Predictions and scores against dictionaries of counts; the filter's false positives are all that may differ."""
    docs = [(r.doc_id, r.text, r.lang) for r in spark.read.parquet("/root/testdata/sf0.001/documents.parquet").collect()]
    docs += [(10_000 + i, t, None) for i, t in enumerate(["a", "I!", "x!", "我", "à", "ab", " z ", "é 1", "", None, "12 !"])]
    docs += [(20_000 + i, r[1], r[2]) for i, r in enumerate(documents())]
    counts, sums = {}, Counter()
    for i, t, lang in docs:
        if t is not None and lang is not None and not out_of_fold(i, 3):
            sums[lang] += len(t)
            for g in plain_grams(t):
                counts.setdefault(g, Counter())[lang] += 1
    own = {}
    for g, by in counts.items():
        rate = {k: n / sums[k] for k, n in by.items() if n >= language_id.MIN_COUNT}
        own[g] = {k for k, r in rate.items() if r >= max(rate.values()) * language_id.RATIO}
    df = spark.createDataFrame(docs, "doc_id long, text string, lang string").repartition(3)
    got = {(r.doc_id, r.lang_pred, round(r.score, 6)) for r in language_id.identified(df).collect()}
    model = language_id.fold_trained(df)
    assert model[0] == sorted(sums)
    assert ((model[1][:, 0, None] >> np.arange(len(sums))) & 1).mean(axis=0).max() < 0.4
    near = 0
    for i, t, _ in docs:
        grams = plain_grams(t)
        share = {k: sum(k in own.get(g, ()) for g in grams) / len(grams) if grams else 0.0 for k in sorted(sums)}
        best = max(share, key=share.get) if grams else "und"
        ((lang, score),) = {(k, v) for d, k, v in got if d == i}
        assert (lang == "und") == (not grams)
        near += lang == best and (not grams or abs(score - share[best]) < 0.03)
    assert near >= 0.99 * len(docs)


def test_a_filter_that_is_too_small_keeps_the_common_ngrams(spark):
    docs = spark.read.parquet("/root/testdata/sf0.001/documents.parquet")
    langs, table = language_id.train(docs, most=3000)
    assert len(table) <= 8 * 4096 * 2
    got = language_id.language_id(docs, (langs, table)).join(docs.select("doc_id", "lang"), "doc_id").collect()
    assert sum(r.lang_pred == r.lang for r in got) > 0.95 * len(got)


def test_ngrams_of_a_batch_are_those_of_its_texts():
    texts = ["Ab c", None, "!!", "x", "hello wörld", "", "a\nb", "I"]
    h, at = language_id.ngrams(texts)
    for i, t in enumerate(texts):
        assert list(h[at[i] : at[i + 1]]) == list(language_id.ngrams([t])[0])
        assert at[i + 1] - at[i] == len(plain_grams(t))


def test_words_are_hashed_by_their_bytes_alone(monkeypatch):
    """Sums run over blocks' edges and other words; a word's hash is the one of its bytes by the definition."""
    from shoal.llm import hashing

    base, table = int(hashing.P), [int(x) for x in hashing.BYTES]
    raw = [b"", b"a", b"  one two\tone ", "é ß".encode(), b"x" * 200 + b" y", b"one", b" \n "]
    want = [(i, sum(table[c] * base ** (j + 1) for j, c in enumerate(w)) % 2**64) for i, r in enumerate(raw) for w in r.split()]
    for block in (7, 16, hashing.BLOCK):
        monkeypatch.setattr(hashing, "BLOCK", block)
        got, text = hashing.word_hashes(raw)
        assert got.tolist() == hashing.mixed(np.array([h for _, h in want], np.uint64)).tolist() and text.tolist() == [i for i, _ in want]
    assert len(hashing.word_hashes([])[0]) == len(hashing.word_hashes([b"", b" "])[0]) == 0


def test_frequent_rows_are_found_by_their_first_bits(monkeypatch):
    """Few of the keys are searched for; those that share first bits, the smallest and the largest are found too."""
    rng, searched = np.random.default_rng(4), []
    keys = np.concatenate((rng.integers(0, 2**63, 20_000).astype(np.uint64) * np.uint64(2), np.arange(50, dtype=np.uint64), [2**64 - 1])).astype(np.uint64)
    asked = np.concatenate((keys, keys + np.uint64(1), rng.integers(0, 2**63, 20_000).astype(np.uint64)))
    plain = np.searchsorted
    monkeypatch.setattr(np, "searchsorted", lambda a, v, *more: searched.append(len(v)) or plain(a, v, *more))
    for own in (np.unique(keys), keys[:1], keys[:0]):
        at, hit = suffix_tree.Head(own).find(asked)
        assert hit.tolist() == np.isin(asked, own).tolist() and (own[at[hit]] == asked[hit]).all()
    assert sum(searched) < len(asked) / 2


def test_counts_are_folded_in_order_of_first_bits():
    rng = np.random.default_rng(5)
    for n in (0, 1, 2, 5000):
        keys = rng.integers(-(2**63), 2**63 - 1, 3000)[rng.integers(0, 3000, n)]
        places = suffix_tree.sorted_places(keys)
        assert sorted(places.tolist()) == list(range(n)) and np.array_equal(keys[places].view(np.uint64), np.sort(keys.view(np.uint64)))
    held = np.array([0, 1, 5, 2**27 - 1, 2**40 + 3, 2**64 - 1], np.uint64)
    bits = np.zeros(1 << 10, np.uint64)
    for at in suffix_tree._spots(held, 1 << 16):
        np.bitwise_or.at(bits, (at >> np.uint64(6)).astype(np.int64), np.uint64(1) << (at & np.uint64(63)))
    asked = np.concatenate((held, np.arange(100, 200, dtype=np.uint64) * np.uint64(0x9E3779B97F4A7C15)))
    want = [all(int(bits[int(x) >> 6]) >> (int(x) & 63) & 1 for x in (at[i] for at in suffix_tree._spots(asked, 1 << 16))) for i in range(len(asked))]
    assert suffix_tree.maybe(bits, asked).tolist() == want and all(want[: len(held)]) and not all(want)


def test_events_are_dealt_in_blocks_and_summed(monkeypatch):
    """Few rows leave a task; sums over tasks are those of plain counts, also of keys that share their first bits."""
    from types import SimpleNamespace

    rng = np.random.default_rng(6)
    tasks = [[" ".join(f"w{i}" for i in rng.zipf(1.4, 40) % 60) for _ in range(100)] for _ in range(3)]
    every = SimpleNamespace(value=np.full(16, 2**64 - 1, np.uint64))
    want = Counter()
    for raw in (t.encode() for texts in tasks for t in texts):
        _, keys, valid = suffix_tree.sequences([raw], 2)
        own = np.stack([suffix_tree.before(keys[1]), keys[1]], 1)[valid[2]].view(np.int64)
        want.update(map(tuple, own.tolist()))
    plain = suffix_tree.joined
    for key in (plain, lambda a, b: np.unique(plain(a, b), return_inverse=True)[1].astype(np.uint64)):
        monkeypatch.setattr(suffix_tree, "joined", plain)
        dealt = [pa.Table.from_batches(suffix_tree._event_rows(2, every, 8)(iter([pa.record_batch({"text": texts})]))) for texts in tasks]
        assert all(t.num_rows == 8 and t["part"].to_pylist() == list(range(8)) for t in dealt)
        monkeypatch.setattr(suffix_tree, "joined", key)
        got = []
        for part in range(8):
            out = suffix_tree._summed(2)(pa.concat_tables([t.slice(part, 1) for t in dealt]))
            got += zip(*(out[x].to_pylist() for x in ("c", "up", "n")), strict=True)
        assert {(c, up): n for c, up, n in got} == {e: n for e, n in want.items() if n >= 2} and len(got) < len(want)
    assert suffix_tree._summed(2)(dealt[0].slice(0, 0)).num_rows == 0


def test_blocks_come_in_bounded_batches():
    part, n = np.sort(np.arange(300_000) % 1000).astype(np.int32), np.arange(300_000)
    got = list(suffix_tree.blocks(part, (n,), ["n"], 1024))
    assert max(sum(map(len, b["n"].to_pylist())) for b in got) <= 1 << 16 and sum(b.num_rows for b in got) == 1000
    assert [x for b in got for x in b["n"].values.to_pylist()] == n.tolist()


@pytest.mark.parametrize("bits", [64, 1 << 10, 1 << 16])
def test_filters_hold_their_keys_bits(spark, bits):
    for n in (0, 1, 500):
        df = spark.range(n).select(F.xxhash64("id").alias("k")).repartition(3)
        keys = np.array([r.k for r in df.collect()], np.int64).view(np.uint64)
        got = suffix_tree.bitmap(df, bits)
        on = np.flatnonzero(np.unpackbits(got.view(np.uint8), bitorder="little"))
        assert on.tolist() == sorted({int(s) for at in suffix_tree._spots(keys, bits) for s in at})
        assert len(got) == bits // 64 and suffix_tree.maybe(got, keys).all()


def test_scores_sort_only_large_sides_of_joins(spark, monkeypatch):
    docs = table(spark).repartition(2)
    plan = lambda df: df._jdf.queryExecution().executedPlan().toString()
    hashing = suffix_tree.fold_scores(docs)
    assert plan(hashing).count("ShuffledHashJoin") == 2 and "SortMergeJoin" not in plan(hashing)
    monkeypatch.setattr(suffix_tree, "HASHED_ROWS", 0)
    sorting = suffix_tree.fold_scores(docs)
    assert "ShuffledHashJoin" not in plan(sorting)
    of = lambda df: sorted((str(r.doc_id), r.n_known, round(r.base_score, 6), round(r.score, 6)) for r in df.collect())
    assert of(hashing) == of(sorting)
