"""Mixing, url filters and toxicity on small fixtures."""

import random
from collections import defaultdict

import pytest
from pyspark.sql import functions as F

from factloom.llm import mixing, toxicity, url_templates
from factloom.llm.queries import RULES

DOCS = "doc_id long, text string, source string, size long"


def mixed(docs, **settings):
    rows = mixing.schedule(docs, **settings).groupBy("row_id", "doc_id", "source", "size", "source_size", "target").agg(F.sum("served").alias("taken"))
    return sorted(((r["doc_id"] or -1, r["source"], r["size"], r["source_size"], r["target"], r["taken"]) for r in rows.collect()), key=str)


def mix_rows():
    rnd = random.Random(5)
    rows = [(i, " ".join("w" * (i % 3 + 1) for _ in range(rnd.randint(0, 40))), rnd.choice(["a", "b", "B", "é", None, "big", "big", "big"]), 1) for i in range(400)]
    return rows + [(None, "x y", "a", 1), (1, "p q r", "b", 1), (1, "p q r", "b", 1), (2, None, "only-empty", 1), (3, "long " * 5000, "a", 1)]


def test_targets_and_shares(spark, monkeypatch):
    monkeypatch.setattr(mixing, "BUCKET_ROWS", 16)
    rows = mix_rows()
    got = mixed(spark.createDataFrame(rows, DOCS).repartition(5))
    assert len(got) == len(rows)
    sizes, taken, target = defaultdict(int), defaultdict(int), {}
    for _, t, s, _ in rows:
        sizes[s] += len((t or "").split())
    for _, s, size, source_size, goal, took in got:
        assert source_size == sizes[s] and 0 <= took <= 2 * size
        taken[s] += took
        target[s] = goal
    assert abs(sum(target.values()) - 1.5 * sum(sizes.values())) < 1e-6
    for s in sizes:
        assert target[s] <= 2 * sizes[s] + 1e-9 and abs(taken[s] - target[s]) < 2
    order = sorted(sizes, key=lambda s: (s is None, s))
    open_ = [s for s in order if target[s] < 2 * sizes[s] - 1e-9]
    weights = {s: (3, 1, 2)[i % 3] for i, s in enumerate(order)}
    assert len({round(target[s] / weights[s], 6) for s in open_}) <= 1
    assert got == mixed(spark.createDataFrame(rows[::-1], DOCS).repartition(2))


def test_mixed_documents(spark):
    docs = spark.createDataFrame(mix_rows(), DOCS).repartition(3)
    words, goal = defaultdict(int), {r["source"]: r["target"] for r in mixing.schedule(docs).collect()}
    out = mixing.mixed_documents(docs)
    assert out.columns == docs.columns
    for r in out.collect():
        assert r["text"].split()
        words[r["source"]] += len(r["text"].split())
    assert all(abs(words[s] - goal[s]) < 2 for s in goal)
    times = [r["virtual_finish"] for r in mixing.mix(docs).collect()]
    assert times == sorted(times)
    assert mixed(docs.limit(0)) == [] and mixing.mixed_documents(docs.limit(0)).count() == 0


def url_parts(url):
    if url is None or "://" not in url:
        return "", ""
    rest = url.split("://", 1)[1]
    end = min([rest.find(c) for c in "/?#" if c in rest] or [len(rest)])
    stop = min([rest.find(c) for c in "?#" if c in rest] or [len(rest)])
    return "".join(c.lower() if "A" <= c <= "Z" else c for c in rest[:end]), rest[end : max(end, stop)]


def test_url_rules(spark):
    urls = [None, "", "no scheme/en/", "http://x.com/en/1", "http://com/en/", "http://com/en", "HTTP://A.Example.COM/en/71?x", "://net/de/", "https://example.net/de/8#", "http://xexample.net/de/8", "http://a.org/es/é\n1", "x://y://org/es/", "http://É.org", "http://a?b/c", "http://a#b", "http://examplecom/en/"]
    pages = spark.createDataFrame([(i, u, "h") for i, u in enumerate(urls)] + [(0, None, "h"), (None, "http://com/en/", "h")], "page_id long, url string, host string")
    got = url_templates.filter_urls(pages, RULES).collect()
    assert len(got) == len(urls) + 2
    for r in got:
        url = urls[r["page_id"]] if r["page_id"] is not None else "http://com/en/"
        host, path = url_parts(url)
        assert (r["host"], r["path"]) == (host, path)
        fits = [(len(h) + len(p), h + p, v) for h, p, v in RULES if (host == h or host.endswith("." + h)) and path.startswith(p)]
        assert r["rule"] == (max(fits)[1] if fits else None)
        assert r["verdict"] in ({max(fits)[2]} if fits else {"allow", "block"})
    assert url_templates.filter_urls(pages.limit(0), RULES).count() == 0


def test_url_templates_learn(spark):
    rows = [(i, f"http://h.x/ads/{i}", 1) for i in range(30)] + [(100 + i, f"http://h.x/news/{i}.html", 0) for i in range(30)] + [(200 + i, f"http://h.x/tag/word{'abcdefghij'[i % 10]}{'klmnopqrst'[i // 10]}/p", 1) for i in range(60)]
    pages = spark.createDataFrame([(i, u) for i, u, _ in rows] + [(900, "http://h.x/ads/77777"), (901, "http://h.x/news/5.html"), (902, "http://other.x/ads/1"), (903, "http://h.x/tag/wordzz/p")], "page_id long, url string")
    labels = spark.createDataFrame([(i, b) for i, _, b in rows], "page_id long, blocked int")
    got = {r["page_id"]: r for r in url_templates.filter_urls(pages, [], labels=labels).collect()}
    assert [got[i]["verdict"] for i in (900, 901, 902, 903)] == ["block", "allow", "allow", "block"]
    assert got[900]["template"] == "/ads/*" and got[903]["template"] == "/tag/*/p"


def brute_verdicts(urls, labels):
    """Template and verdict of each url, branch by branch over lists of all urls."""
    import math
    import re

    paths = []
    for i, url in urls:
        host, path = url_parts(url)
        segments = [x for x in path.split("/") if x]
        paths.append((i, host, [("*" + (re.search(r"(\.[A-Za-z]{1,5})$", x) or [""])[0]) if re.match(url_templates.VARIABLE, x) else x for x in segments]))
    sums = lambda ids: (len(ids), sum(i in labels for i in ids), sum(labels.get(i, 0) for i in ids))
    names = {}
    for host in {h for _, h, _ in paths}:
        todo = [()]
        while todo:
            above = todo.pop()
            own = [(i, f) for i, h, f in paths if h == host and tuple(f[: len(above)]) == above and len(f) > len(above)]
            children = {}
            for i, f in own:
                children.setdefault(f[len(above)], []).append(i)
            n_all, known_all, bad_all = sums([i for i, _ in own])
            kinds, kept = {}, {}
            for name, ids in children.items():
                n, known, bad = sums(ids)
                rest, pooled = known_all - known, bad_all / known_all if known_all else 0
                differs = known > 0 and rest > 0 and 0 < pooled < 1 and abs(bad / known - (bad_all - bad) / rest) >= 2 * math.sqrt(pooled * (1 - pooled) * (1 / known + 1 / rest))
                kept[name] = not (len(children) > 16 and n < 0.02 * n_all and not differs)
                rate = (bad + 4 * ((bad_all + 2) / (known_all + 4))) / (known + 4)
                if kept[name] and known:
                    kinds[name] = math.floor(math.asin(math.sqrt(min(1.0, rate))) / (0.5 / math.sqrt(known_all / len(children) + 4)))
                todo.append((*above, name))
            for name in children:
                alike = min([x for x in kinds if kinds[x] == kinds.get(name)], default=name)
                names[host, (*above, name)] = (name, alike) if kept[name] else ("*", "*")
    path_of = lambda h, f, k: "".join("/" + names[h, tuple(f[: j + 1])][k] for j in range(len(f)))
    out = {}
    for i, host, f in paths:
        same = [j for j, h, g in paths if h == host and path_of(h, g, 1) == path_of(host, f, 1)]
        _, known, bad = sums(same)
        _, known_host, bad_host = sums([j for j, h, _ in paths if h == host])
        purity = (bad + 4 * (bad_host + 2) / (known_host + 4)) / (known + 4)
        out[i] = (path_of(host, f, 0), round(purity, 9), "block" if known and purity >= 0.6 else "allow")
    return out


def test_url_templates_against_brute_force(spark):
    rnd = random.Random(11)
    rates = {"ads": 0.95, "buy": 0.9, "news": 0.05, "blog": 0.1, "mix": 0.5}
    urls, labels = [], {}
    for i in range(500):
        host, top = rnd.choice(["a.x", "a.x", "b.x"]), rnd.choice([*rates, "none", f"s{rnd.randrange(60)}"])
        deep = "/".join(str(rnd.choice(["p", "q", rnd.randrange(99), "x.html"])) for _ in range(rnd.randrange(9)))
        urls.append((i, f"http://{host}/{top}/{deep}"))
        if top != "none" and rnd.random() < 0.6:
            labels[i] = int(rnd.random() < rates.get(top, 0.3 + 0.6 * (top == "s1")))
    urls += [(600, None), (601, "http://a.x"), (602, "http://a.x/" + "y/" * 300)]
    pages = spark.createDataFrame(urls, "page_id long, url string").repartition(3)
    known = spark.createDataFrame(list(labels.items()), "page_id long, blocked int")
    got = {r["page_id"]: (r["template"], round(r["purity"], 9), r["verdict"]) for r in url_templates.filter_urls(pages, [], labels=known).collect()}
    want = brute_verdicts(urls, labels)
    assert got == want
    assert {"block", "allow"} == {v for _, _, v in got.values()}


INSULTS = ["grobian", "knave", "dullard"]


def toxic_rows(n, seed):
    rnd = random.Random(seed)
    syllables = ["tha", "ing", "re", "on", "ble", "ti", "st", "nd", "ea", "our", "an", "es"]
    out = []
    for i in range(n):
        words = ["".join(rnd.choices(syllables, k=rnd.randint(1, 4))) for _ in range(rnd.randint(5, 80))]
        toxic = rnd.random() < 0.3
        if toxic:
            words.insert(rnd.randrange(len(words)), rnd.choice(INSULTS))
        out.append((i, " ".join(words), int(toxic)))
    return out


@pytest.fixture(scope="module")
def model(spark):
    rows = toxic_rows(600, 1)
    docs = spark.createDataFrame([r[:2] for r in rows], "doc_id long, text string")
    labels = spark.createDataFrame([(r[0], r[2]) for r in rows] + [(5, None), (None, 1), (99999, 1)], "doc_id long, toxic int")
    return toxicity.fit(docs, labels)


def test_held_out_accuracy(spark, model):
    rows = toxic_rows(400, 2)
    docs = spark.createDataFrame([(i, t, 0.0) for i, t, _ in rows], "doc_id long, text string, score double").repartition(3)
    got = {r["doc_id"]: r for r in toxicity.score(docs, model).collect()}
    assert all(0 <= r["score"] <= 1 and r["predicted"] == int(r["score"] >= 0.3) for r in got.values())
    assert sum(got[i]["predicted"] == y for i, _, y in rows) >= 0.98 * len(rows)
    kept = toxicity.keep_clean(docs, model)
    assert kept.columns == docs.columns and {r["doc_id"] for r in kept.collect()} == {i for i in got if not got[i]["predicted"]}


def test_obfuscated_insults(model):
    bad = ["tha ing g r o b i a n re", "tha kn.a-ve ing", "on du11ard ble", "GROBIAN!", "tha groobian ing", "tha knnave", "a dull4rd"]
    good = ["tha ing re on", "", "   ", "\u00e9", "reonble tiest"]
    scores = model.score([t.encode() for t in bad + good])
    assert min(scores[: len(bad)]) > max(scores[len(bad) :])


def test_toxicity_odd_rows(spark):
    docs = spark.createDataFrame([(1, None), (1, None), (None, "x")], "doc_id long, text string")
    none = spark.createDataFrame([], "doc_id long, toxic int")
    assert [r["score"] < 0.01 for r in toxicity.score(docs, toxicity.fit(docs, none)).collect()] == [True] * 3
    assert toxicity.score(docs.limit(0), toxicity.fit(docs, none)).count() == 0
    long = "word " * 1_000_000 + "end"
    assert len(toxicity.train([b"x"], [b"y"], 0.5).score([long.encode(), b""])) == 2
