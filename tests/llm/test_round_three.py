"""URL filters, phrases and clusters against brute force, with nulls, ties, repeats, hot keys and empty tables."""

import hashlib
import random
import re
from collections import Counter
from fractions import Fraction

import numpy as np
import pytest
from fixtures import documents, empty, table

from shoal.llm import phrases, pivot_clusters, registry, url_filters

# URL filters


def parts(url):
    rest = url.split("://", 1)[1] if url and "://" in url else ""
    host = re.match(r"[^/?#]*", rest)[0]
    return re.sub("[A-Z]", lambda m: m[0].lower(), host), re.match(r"[^?#]*", rest[len(host) :])[0]


def judged(url, rules, default="allow"):
    host, path = parts(url)
    fits = [(len(h + p), len(h), h + p, v) for h, p, v in rules if (host == h or host.endswith("." + h)) and path.startswith(p)]
    return (host, path, max(fits)[2], max(fits)[3]) if fits else (host, path, None, default)


PAGE = "page_id long, url string, host string, node string, verdict string"
ODD = [None, "", "no scheme", "://", "http://", "HTTP://EXAMPLE.Com/En/", "http://example.com?x=://y.net/es/", "http://a.b/c#d", "x://y://example.com/en/", "http://com/", "http://com", "http://example.com./en/", "http://example.com:80/en/", "http://u@www.example.com/en/1"]


@pytest.mark.parametrize("seed", range(3))
def test_url_filters_equal_brute_force(spark, seed):
    """Rules nest in hosts and in paths; one host has a third of the rows and some rules are given twice."""
    rng = random.Random(seed)
    host = lambda: ".".join(rng.choice("abc") for _ in range(rng.randrange(1, 5)))
    path = lambda: "/" + "".join(rng.choice("xy/") for _ in range(rng.randrange(6)))
    rules = [(host(), rng.choice([path(), "/", ""]), rng.choice(["allow", "block"])) for _ in range(60)]
    rules += [(h, p, "block") for h, p, _ in rules[:3]]
    urls = [f"http://{host()}{rng.choice([path(), '', path() + '?q=1', path() + '#f'])}" for _ in range(400)] + [f"http://a.b{path()}" for _ in range(200)] + ODD
    rows = [(i if i % 7 else None, u, "clash", "clash", "clash") for i, u in enumerate(urls)]
    spark.conf.set("spark.sql.shuffle.partitions", "7")
    try:
        got = url_filters.url_filters(spark.createDataFrame(rows + rows[:5], PAGE).repartition(4), spark.createDataFrame(rules, "host string, path string, verdict string"), default="none")
        want = [(i, *judged(u, rules, "none")) for i, u, *_ in rows + rows[:5]]
        assert Counter(map(tuple, got.collect())) == Counter(want)
    finally:
        spark.conf.set("spark.sql.shuffle.partitions", "4")


def test_a_rule_reaches_over_many_ranges(spark):
    """One rule is open over all range partitions, also those in which no rule begins."""
    urls = [(i, f"http://h{i % 9}.example.com/p{i:05d}/") for i in range(3000)]
    rules = [("example.com", "/", "block"), ("h3.example.com", "/p00", "allow")]
    got = url_filters.url_filters(spark.createDataFrame(urls, "page_id long, url string"), spark.createDataFrame(rules, "host string, path string, verdict string"))
    assert {r.page_id: (r.rule, r.verdict) for r in got.collect()} == {i: judged(u, rules)[2:] for i, u in urls}


def test_long_hosts_no_rules_and_empty_tables(spark):
    long = "http://" + ".".join(["x"] * 50_000) + ".net/es/" + "y" * 100_000
    pages = spark.createDataFrame([(1, long), (2, None)], "page_id long, url string")
    rules = spark.createDataFrame(registry.URL_RULES, "host string, path string, verdict string")
    assert [(r.page_id, r.rule, r.verdict) for r in url_filters.url_filters(pages, rules).orderBy("page_id").collect()] == [(1, "net/es/", "block"), (2, None, "allow")]
    assert [(r.rule, r.verdict) for r in url_filters.url_filters(pages, rules.limit(0)).collect()] == [(None, "allow")] * 2
    assert url_filters.url_filters(pages.limit(0), rules).count() == 0


# Phrases


def brute(rows, least, most=2000, cover=80):
    f, n = Counter(), Counter()
    for lang, text in rows:
        lang = "und" if lang is None else lang
        for piece in re.split(r"[.,;:!?\x0A-\x0D]", re.sub("[A-Z]", lambda m: m[0].lower(), text or "")):
            w = re.findall(r"[^\x20\x09]+", piece)
            n[lang] += len(w)
            f.update((lang, *w[i : i + k]) for k in range(1, 5) for i in range(len(w) - k + 1))
    found = {g: a for g, a in f.items() if len(g) > 2 and a >= least}
    longer = {}
    for (lang, *w), a in found.items():
        for m in range(2, len(w)):
            for i in range(len(w) - m + 1):
                g = (lang, *w[i : i + m])
                longer[g] = max(longer.get(g, 0), a)
    out = []
    for lang in n:
        own = []
        for g, a in found.items():
            if g[0] == lang and 100 * longer.get(g, 0) < cover * a:
                cuts = [(int(Fraction(2000000 * a, f[g[: k + 1]] + f[(lang, *g[k + 1 :])])), k, f[g[: k + 1]], f[(lang, *g[k + 1 :])]) for k in range(1, len(g) - 1)]
                score, _, l, r = min(cuts)
                own.append((-score, -a, " ".join(g[1:]).encode(), l, r))
        out += [(lang, i + 1, p.decode(), -a, l, r, n[lang], -s) for i, (s, a, p, l, r) in enumerate(sorted(own)[:most])]
    return sorted(out)


def held(df):
    return sorted(map(tuple, df.select("lang", "rank", "phrase", "a", "l", "r", "n", "score").collect()))


def prose(seed, n=150):
    rng = random.Random(seed)
    words = ["the", "of", "New", "york", "Öl", "é", "x.y", "a\u2028b", "—", "stone", "river", "bright", "\u00a0nb"]
    rows = [(i, rng.choice(["en", "fr", None, "und", "zz"]), "".join(rng.choice(words) + rng.choice([" ", " ", "  ", "\t", ", ", "\n", "\r\n", "! "]) for _ in range(rng.randrange(60)))) for i in range(n)]
    rows += [(None, "en", "of the of the of the " * 400), (7, "en", None), (7, None, ""), (8, "fr", " ., \n"), rows[0], (9, "en", "w" * 50_000 + " the " * 2000)]
    return [(i, t, lang, "s", 1, "k", "p", "f") for i, lang, t in rows]


@pytest.mark.parametrize("cut", [False, True])
def test_phrases_equal_brute_force(spark, monkeypatch, cut):
    """Whole, and cut into many prefix ranges, some of which part one word's windows."""
    rows = prose(3)
    if cut:
        monkeypatch.setattr(phrases, "RANGE", 1500)
        monkeypatch.setattr(phrases, "SAMPLE", 1.0)
        assert len(phrases.cut_points(table(spark, rows).select("text", "lang").fillna({"text": "", "lang": "und"}))) > 10
    want = brute([(lang, t) for _, t, lang, *_ in rows], 4)
    assert len(want) > 100
    assert held(phrases.phrases(table(spark, rows), least=4)) == want


def test_phrases_keep_the_first_and_count_fixture_texts(spark):
    rows = documents()
    assert held(phrases.phrases(table(spark, rows), least=3, most=7, cover=50)) == brute([(r[2], r[1]) for r in rows], 3, 7, 50)
    assert phrases.phrases(empty(spark)).count() == 0
    assert phrases.phrases(table(spark, [(1, None, None, None, None, None, None, None)])).count() == 0


def test_long_texts_are_taken_in_parts_between_pieces():
    rng = random.Random(8)
    for _ in range(200):
        t = bytes(rng.choice(b"ab .\n" if rng.random() < 0.5 else b"abc  ") for _ in range(rng.randrange(80)))
        parts = [p for p in phrases.at_breaks(t, 10) if p]
        assert b"".join(parts) == t
        assert all(p[-1:] in phrases.BREAKS for p in parts[:-1]) and all(len(p) <= 10 or not any(c in p[:-1] for c in phrases.BREAKS) for p in parts)


def test_automata_keep_and_add_counts():
    """Parts between random cuts, packed and unpacked, united: each path's weight is its phrase's count."""
    rng, want = random.Random(5), Counter()
    shards = []
    for _ in range(6):
        texts = [" ".join(rng.choice("abcdef") + rng.choice(["", ".", "g"]) for _ in range(rng.randrange(30))).encode() for _ in range(20)]
        langs, own = ["de", "en"], [rng.randrange(2) for _ in texts]
        for t, lang in zip(texts, own, strict=True):
            for piece in re.split(rb"\.", t):
                w = piece.split()
                want.update((langs[lang], *w[i : i + k]) for k in range(1, 5) for i in range(len(w) - k + 1))
        of, ranks, words = phrases.windows(texts)
        shards.append((langs, np.array(own)[of], ranks, words.to_pylist()))
    pick = lambda: rng.choice([b"a", b"b", b"cg", b"dd", b"zz", b"0"])
    cuts = sorted({(rng.choice(["cc", "de", "en", "fr"]), pick(), pick(), rng.choice([None, pick()]), None) for _ in range(12)}, key=lambda c: [x or b"" if not isinstance(x, str) else x.encode() for x in c])
    seen: Counter = Counter()
    by: dict = {}
    for s in shards:
        for r, a in phrases.built(*s, cuts):
            by.setdefault(r, []).append(phrases.unpacked(phrases.packed(a), a.langs))
    assert len(by) > 3
    for held_parts in by.values():
        a = phrases.united([phrases.united(held_parts[:2]), *held_parts[2:]])
        paths = [(x,) for x in a.langs]
        for d in range(phrases.LONGEST):
            paths = [(*paths[p], a.words[w]) for p, w in zip(a.parents[d].tolist(), a.labels[d].tolist(), strict=True)]
            assert len(set(paths)) == len(paths)
            seen.update(dict(zip(paths, a.weights[d].tolist(), strict=True)))
    assert seen == want


# Clusters


def brute_clusters(rows, k, rounds, size):
    ok = [(i, [int(np.floor(64 * float(x))) for x in v]) for i, v in rows if v is not None and len(v) == size and all(x is not None and np.isfinite(x) for x in v)]
    first = sorted(ok, key=lambda r: (hashlib.sha256(f"1:{'' if r[0] is None else r[0]}".encode()).hexdigest(), r[1]))[:k]
    centroids = [v for _, v in first]
    near = lambda v: min((sum((a - b) ** 2 for a, b in zip(v, c, strict=True)), j) for j, c in enumerate(centroids))
    for _ in range(rounds):
        groups: dict = {}
        for _, v in ok:
            groups.setdefault(near(v)[1], []).append(v)
        centroids = [[sum(x) // len(groups[j]) for x in zip(*groups[j], strict=True)] if j in groups else c for j, c in enumerate(centroids)]
    got = [(i, *near(v)[::-1]) for i, v in ok]
    own = Counter()
    for _, c, d in got:
        own[c] += d
    return Counter((i, c, d, own[c], sum(own.values()), hashlib.sha256(",".join(map(str, centroids[c])).encode()).hexdigest()) for i, c, d in got)


@pytest.mark.parametrize("seed", range(3))
def test_clusters_equal_brute_force(spark, seed):
    """Ties on a coarse grid, a hot vector, negative means, bad vectors, repeated and missing ids."""
    rng = random.Random(seed)
    vec = lambda: [rng.randrange(-3, 3) / 64 + rng.choice([0, 0.001]) for _ in range(8)]
    rows = [(i, vec()) for i in range(300)] + [(1000 + i, [0.5] * 8) for i in range(150)]
    rows += [(5, vec()), (None, vec()), (None, vec()), rows[9], (2000, None), (2001, []), (2002, [1.0] * 7), (2003, [1.0] * 9), (2004, [float("nan")] + [0.0] * 7), (2005, [float("-inf")] + [0.0] * 7), (2006, [None] + [0.0] * 7)]
    df = spark.createDataFrame([(i, v, "clash", 1) for i, v in rows], "vec_id long, embedding array<double>, cluster string, distance int").repartition(5)
    got = pivot_clusters.clusters(df, k=6, rounds=3, size=8, n_pivots=3)
    assert Counter(map(tuple, got.collect())) == brute_clusters(rows, 6, 3, 8)


def test_few_vectors_none_and_too_wide(spark):
    make = lambda rows: spark.createDataFrame(rows, "vec_id long, embedding array<float>")
    rows = [(1, [1.0, 2.0]), (2, [1.0, 2.0]), (3, [-1.0, 0.0])]
    assert Counter(map(tuple, pivot_clusters.clusters(make(rows), size=2).collect())) == brute_clusters(rows, 16, 3, 2)
    assert pivot_clusters.clusters(make([(1, None)]), size=2).count() == 0
    assert pivot_clusters.clusters(make(rows).limit(0), size=2).count() == 0
    with pytest.raises(Exception, match="a component leaves"):
        pivot_clusters.clusters(make([(1, [1e9, 0.0])]), size=2).collect()


def test_bounds_spare_distances_and_lose_none():
    rng = np.random.default_rng(4)
    for spread in (3, 1000, 1 << 26):
        centers = rng.integers(-spread, spread, (16, 64))
        rows = np.concatenate([centers[rng.integers(0, 16, 500)] + rng.integers(-spread // 16 - 1, spread // 16 + 1, (500, 64)), centers])
        pivots = pivot_clusters.far_apart(centers, 8)
        which, best, exact = pivot_clusters.nearest(rows, pivot_clusters.pivot_distances(rows, pivots), centers, pivot_clusters.pivot_distances(centers, pivots))
        every = ((rows[:, None, :] - centers[None]) ** 2).sum(axis=2)
        assert (which == every.argmin(axis=1)).all() and (best == every.min(axis=1)).all()
        assert exact < len(rows) * 8
