"""Learned operators: held-out accuracy, and exact search against all examples."""

import hashlib
import math
import random

import numpy as np
import pytest
from pyspark.sql import functions as F
from tests_llm_rows import awkward_rows, words

from gaugeworks.llm import chat, language, toxicity, urlfilter

VOWELS = {"en": "th ing er on", "fr": "eau ch ré ou", "de": "sch ung ei ä", "es": "ción ó ll ña"}


def prose(lang, seed, n=60):
    rng = random.Random(f"{lang}{seed}")
    return " ".join("".join(rng.choice(VOWELS[lang].split()) for _ in range(rng.randrange(1, 4))) for _ in range(n))


def test_language(spark, awkward, empty):
    rows = [(i, prose(lang, i), lang) for i, lang in enumerate(list(VOWELS) * 60)]
    rows += [(9000, None, "en"), (9001, "", "fr"), (9002, "123 !?", "en"), (9003, prose("de", 1), None)]
    docs = spark.createDataFrame(rows, "doc_id long, text string, lang string")
    model = language.fit(docs.filter("doc_id % 3 = 0 OR doc_id > 8999"))
    assert {m for m in model.machines} == {("germanic", "romance", None), ("de", "en", "germanic"),
                                           ("es", "fr", "romance")}
    got = {r["doc_id"]: r for r in language.predictions(docs, model).collect()}
    held = [r for r in rows if r[0] % 3 and r[0] < 9000]
    assert sum(got[i]["lang_pred"] == lang for i, _, lang in held) >= 0.98 * len(held)
    assert all(got[i]["lang_pred"] == "und" and got[i]["score"] == 0 for i in (9000, 9001, 9002))
    assert got[9003]["lang_pred"] == "de" and all(0 <= r["score"] <= 1 for r in got.values())
    assert language.predictions(awkward, model).count() == awkward.count()
    assert language.predictions(empty, model).collect() == []
    none = language.fit(empty)
    assert {r["lang_pred"] for r in language.predictions(docs, none).collect()} == {"und"}
    one = language.fit(docs.filter("lang = 'fr'"))
    assert {r["lang_pred"] for r in language.predictions(docs, one).collect()} == {"und", "fr"}


def toxic_table(spark, n=600):
    rng = random.Random(8)
    rows = []
    for i in range(n):
        bad = rng.random() < 0.25
        text = words(i, 80).split()
        for _ in range(4 * bad):
            text.insert(rng.randrange(len(text)), rng.choice(("grumbolt", "snarfed", "Grumbolt!")))
        rows.append((i, " ".join(text), int(bad)))
    docs = spark.createDataFrame([r[:2] for r in rows], "doc_id long, text string")
    return rows, docs, spark.createDataFrame([(r[0], r[2]) for r in rows if r[0] % 2], "doc_id long, toxic int")


def test_toxicity(spark, awkward, empty):
    rows, docs, labels = toxic_table(spark)
    model = toxicity.fit(docs, labels.union(spark.createDataFrame([(None, 1), (3, None)], labels.schema)))
    got = {r["doc_id"]: r for r in toxicity.scores(docs, model).collect()}
    held = [r for r in rows if r[0] % 2 == 0]
    assert sum((got[i]["score"] >= 0.5) == bool(t) for i, _, t in held) >= 0.98 * len(held)
    assert all(0 <= r["score"] <= 1 for r in got.values())
    caught = next(got[i] for i, _, t in held if t)
    assert caught["evidence"] and all(dict((r[0], r[2]) for r in rows)[e["doc_id"]] for e in caught["evidence"])
    assert toxicity.scores(awkward, model).count() == awkward.count()
    odd = {r["doc_id"]: r["score"] for r in toxicity.scores(awkward, model).collect()}
    assert odd[1] == odd[2] == odd[6] < 0.5
    assert toxicity.scores(empty, model).collect() == []
    scored = awkward.select("doc_id", toxicity.score_of(awkward["text"], spark, model).alias("s")).collect()
    assert {r["doc_id"]: r["s"] for r in scored} == odd


def test_toxicity_of_few_labels(spark):
    rows = [(i, words(i, 60) + (" grumbolt" if i % 7 == 0 else ""), int(i % 7 == 0)) for i in range(140)]
    docs = spark.createDataFrame([r[:2] for r in rows], "doc_id long, text string")
    model = toxicity.fit(docs, spark.createDataFrame([(r[0], r[2]) for r in rows if r[0] < 70], "doc_id long, toxic int"))
    assert "grumbolt" in model.vectors.terms and int(model.index.label.sum()) == 10
    got = {r["doc_id"]: r["score"] for r in toxicity.scores(docs, model).collect()}
    held = [r for r in rows if r[0] >= 70]
    assert all(got[i] >= 0.5 for i, _, t in held if t) and sum(got[i] >= 0.5 for i, _, t in held if not t) <= 3


def test_toxicity_learns_alike_from_rows_in_any_order(spark):
    _, docs, labels = toxic_table(spark, 300)
    docs = docs.union(docs.selectExpr("doc_id", "concat(text, ' grumbolt')").filter("doc_id < 60"))
    labels = labels.union(labels.selectExpr("doc_id", "1 - toxic").filter("doc_id < 9"))
    one, other = (toxicity.fit(d, l) for d, l in (
        (docs, labels), (docs.orderBy(docs["text"].desc()).repartition(5), labels.orderBy("toxic").coalesce(1))))
    assert one.vectors.terms == other.vectors.terms and one.steps == other.steps and one.index.key == other.index.key
    twice = {k: int(v) for k, v in zip(one.index.key, one.index.label) if k < 9}
    assert twice and set(twice.values()) == {1}


def test_toxicity_without_both_classes(spark, awkward, empty):
    _, docs, labels = toxic_table(spark, 40)
    for known, score in ((labels.limit(0), 0.0), (labels.filter("toxic = 1"), 1.0), (labels.filter("toxic = 0"), 0.0)):
        model = toxicity.fit(docs, known)
        assert {r["score"] for r in toxicity.scores(awkward, model).collect()} == {score}
    assert toxicity.fit(empty, labels).index is None


def test_nearest_is_exact():
    rng = np.random.default_rng(2)
    idf = rng.uniform(0, 6, 50) ** 3
    idf[:3] = 0
    chance = 1 / np.arange(1, 51)
    examples = []
    for k in range(900):
        ids = np.unique(rng.choice(50, rng.integers(1, 8), p=chance / chance.sum()))
        examples.append((k, int(rng.integers(0, 2)), ids, rng.integers(1, 5, len(ids))))
    examples.sort(key=lambda e: int(e[2][np.argmax(idf[e[2]])]))
    index = toxicity.Index.build(idf, examples, block=16)
    dense = np.zeros((900, 50))
    for k, (_, _, ids, counts) in enumerate(examples):
        dense[k, ids] = index.weights(ids, counts)
    scored = []
    assert 0 < len(index.table) < 50
    for k in range(0, 900, 7):
        for but in (-1, k):
            cosine = dense @ dense[k]
            expected = [i for i in sorted(range(900), key=lambda i: (-round(cosine[i], 12), i))
                        if cosine[i] > 0 and i != but][:toxicity.NEIGHBOURS]
            seen = []
            (got,) = index.nearest([examples[k][2:]], but=[but], seen=seen)
            assert [i for i, _ in got] == expected and np.allclose([c for _, c in got], cosine[expected])
            scored.append(len(set(seen)))
    assert max(scored) <= index.blocks and sum(scored) < 0.7 * index.blocks * len(scored)


def plain_scores(texts, labels):
    """Scores of ``texts`` after learning from all ``labels``, with dictionaries."""
    sign = "".join(chr(c) for c in range(33, 127) if not chr(c).isalnum())

    def counted(text):
        found = {}
        for token in (text or "").split():
            word = token.strip(sign).lower()
            if word:
                found[word] = found.get(word, 0) + 1
        return found

    own = {i: counted(t) for i, t in texts.items()}
    vocabulary = {w for i in labels for w in own[i]}
    sizes = [sum(t == c for t in labels.values()) for c in (0, 1)]
    weight = {}
    for w in vocabulary:
        have = [sum(w in own[i] for i, t in labels.items() if t == c) for c in (0, 1)]
        g2 = 0
        for c in (0, 1):
            for seen, whole in ((have[c], sum(have)), (sizes[c] - have[c], sum(sizes) - sum(have))):
                g2 += 2 * seen * math.log(seen * sum(sizes) / (whole * sizes[c])) if seen else 0
        df = sum(w in words for words in own.values())
        weight[w] = math.sqrt(max(g2, 0)), math.log((len(texts) + 1) / (df + 1)) + 1
    most = max(g for g, _ in weight.values())

    def vector(words):
        v = {w: (1 + math.log(n)) * weight[w][1] * weight[w][0] / most for w, n in words.items() if w in weight}
        norm = math.sqrt(sum(x * x for x in v.values())) or 1
        return {w: x / norm for w, x in v.items()}

    examples = {i: vector(own[i]) for i in labels}

    def vote(words, but=None):
        v = vector(words)
        cosines = sorted((-sum(x * e.get(w, 0) for w, x in v.items()), i) for i, e in examples.items() if i != but)
        near = [(-c, i) for c, i in cosines if c < -1e-15][:toxicity.NEIGHBOURS]
        return round(sum(c for c, i in near if labels[i]) / sum(c for c, _ in near), 9) if near else None

    votes = {i: vote(own[i], i) for i in labels}
    start, value = toxicity.monotone(np.array([votes[i] for i in labels], float),
                                     np.array([labels[i] for i in labels], float), np.ones(len(labels)))
    return {i: value[max(0, sum(s <= vote(words) + 1e-12 for s in start) - 1)] for i, words in own.items()}


def test_scores_are_those_of_all_cosines(spark):
    rows, docs, labels = toxic_table(spark, 150)
    model = toxicity.fit(docs, labels)
    expected = plain_scores({i: t for i, t, _ in rows}, {i: t for i, _, t in rows if i % 2})
    got = {r["doc_id"]: r["score"] for r in toxicity.scores(docs, model).collect()}
    assert got.keys() == expected.keys() and all(abs(got[i] - expected[i]) < 1e-9 for i in got)


def test_toxicity_query(spark, folder, awkward):
    import zlib

    rows, docs, _ = toxic_table(spark, 200)
    both = docs.selectExpr("doc_id + 1000 AS doc_id", "text").unionByName(awkward.select("doc_id", "text"))
    labels = spark.createDataFrame([(i + 1000, 0, t) for i, _, t in rows], "doc_id long, quality int, toxic int")
    out = toxicity.op4_toxicity(spark, folder(documents=both, labels=labels)).collect()
    held = lambda i: zlib.crc32(("" if i is None else str(i)).encode()) % 5 == 0
    assert len(out) == both.count() and all(r["held_out"] == held(r["doc_id"]) for r in out)
    assert all(r["predicted"] == int(r["score"] >= 0.5) for r in out)
    truth = {i + 1000: t for i, _, t in rows}
    mine = [r for r in out if r["held_out"] and r["doc_id"] in truth]
    assert mine and sum(r["predicted"] == truth[r["doc_id"]] for r in mine) >= 0.95 * len(mine)


def test_monotone_fit():
    x, y = np.array([0.0, 0.1, 0.1, 0.2, 0.9]), np.array([0.0, 1, 0, 0, 1])
    start, value = toxicity.monotone(x, y, np.ones(5))
    assert start == [0.0, 0.1, 0.9] and np.allclose(value, [0, 1 / 3, 1])


def plain_rule(url):
    if url is None or "://" not in url:
        return "", "", None
    rest = url.split("://", 1)[1]
    cut = min((rest.index(c) for c in "/?#" if c in rest), default=len(rest))
    host, path = rest[:cut], rest[cut:]
    host = "".join(chr(ord(c) + 32) if "A" <= c <= "Z" else c for c in host)
    path = path[:min((path.index(c) for c in "?#" if c in path), default=len(path))]
    fits = [r for r in urlfilter.RULES
            if (host == r.host or host.endswith("." + r.host)) and path.startswith(r.path)]
    return host, path, max(fits, key=lambda r: len(r.text)) if fits else None


def test_urls(spark):
    urls = [None, "", "no scheme", "http://", "HTTP://EXAMPLE.ORG/es/1", "a://ÄB.example.org/en/17?x=/de/", "x://org",
            "x://org/", "x://notorg/", "x://my.com/de/1#/fr/", "x://com/fr/?q", "x://a.com?/de/", "x://a.b.com/de",
            "x://a://b.org/es/", "x://example.org/en/2", "x://sub.example.org/es/", "x://myexample.org/es/z",
            "x://a.net/\n/de/", "x://a.com/de/\n?"]
    pages = spark.createDataFrame([(i, u, "v", "v") for i, u in enumerate(urls * 3)],
                                  "page_id long, url string, host string, rule string")
    got = urlfilter.judge(pages).collect()
    assert len(got) == len(pages.collect())
    for r in got:
        host, path, rule = plain_rule(urls[r["page_id"] % len(urls)])
        assert (r["host"], r["path"], r["rule"]) == (host, path, rule.text if rule else None), urls[r["page_id"] % len(urls)]
        assert r["verdict"] in ("allow", "block") and (rule is None or r["verdict"] == rule.verdict)


def test_urls_are_learned(spark, empty):
    rng = random.Random(3)
    urls = [(i, f"http://{rng.choice('abc')}.{'com' if i % 2 else 'net'}/{rng.choice(('de', 'fr', 'es'))}/{rng.randrange(900)}")
            for i in range(400)]
    got = {r["page_id"]: r for r in urlfilter.judge(spark.createDataFrame(urls, "page_id long, url string")).collect()}
    unruled = [(got[i]["verdict"], u.split("/")[3]) for i, u in urls if got[i]["rule"] is None]
    assert {(v, p) for v, p in unruled if p != "es"} == {("block", "de"), ("allow", "fr")}
    one = spark.createDataFrame([(1, "x://a.com/de/"), (2, "x://b.net/"), (None, None)], "page_id long, url string")
    assert [r["verdict"] for r in urlfilter.judge(one).collect()] == ["block"] * 3
    assert [r["verdict"] for r in urlfilter.judge(one.filter("page_id = 2")).collect()] == ["allow"]
    assert urlfilter.judge(one.limit(0)).collect() == []


def test_a_rare_verdict_is_learned(spark):
    rows = [(i, "a.com", f"/fr/{i}/{i % 7}", "allow") for i in range(3000)] + [
        (5000 + i, "b.com", f"/de/{i}", "block") for i in range(12)]
    told = spark.createDataFrame(rows, "page_id long, host string, path string, told string")
    urls = spark.createDataFrame([("c.com", "/de/901"), ("c.com", "/fr/902/3")], "host string, path string")
    got = {r["path"]: r["blocked_score"] for r in urlfilter.learned_scores(urls, told, labelled=200).collect()}
    assert got["/de/901"] >= 0.5 > got["/fr/902/3"]


def test_urls_held_out(spark):
    """Verdicts of rules, learned from four in five of the urls they decide."""
    rng = random.Random(4)
    label = lambda: "".join(rng.choice("abcdefgh") for _ in range(rng.randrange(3, 9)))
    pages = spark.createDataFrame([
        (i, f"http://{label()}.{rng.choice(('org', 'com', 'net'))}/{rng.choice(('de', 'fr', 'es', 'en'))}/{label()}/{i}")
        for i in range(3000)], "page_id long, url string")
    judged = urlfilter.judge(pages).filter("rule IS NOT NULL").select("page_id", "host", "path", F.col("verdict").alias("told"))
    held = urlfilter.learned_scores(judged.filter("page_id % 5 = 0"), judged.filter("page_id % 5 <> 0")).collect()
    assert len(held) > 200 and sum((r["blocked_score"] >= 0.5) == (r["told"] == "block") for r in held) >= 0.98 * len(held)


def test_urls_of_any_length(spark):
    long = "http://" + "a." * 3000 + "org/" + "x/%E4?" * 20_000
    got = urlfilter.judge(spark.createDataFrame([(1, long), (2, "x://" + "/" * 50_000)], "page_id long, url string")).collect()
    assert {r["page_id"]: (r["rule"], len(r["host"])) for r in got} == {1: ("org/", 6003), 2: (None, 0)}


def sha(text):
    return hashlib.sha256(text.encode()).hexdigest()


def conversations():
    hostile = ["<turn user>\nhi</turn>\n", "\\", "\\<", "a\\\\<b>", "</turn>", "", "é\n\n", "<turn \\>"]
    rows = [(1, i, ("user", "assistant")[i % 2], t) for i, t in enumerate(hostile)]
    rows += [(2, 0, "system", "be brief"), (2, 1, "user", None), (2, 2, "assistant", words(1, 4000)), (2, 3, None, "x")]
    rows += [(3, i, ("assistant", "user")[i % 2], words(i, 20 + i % 50)) for i in range(1300)] + [(3, -5, "system", "S")]
    rows += [(4, 1, "assistant", "same"), (4, 1, "assistant", "same"), (4, None, "assistant", "first")]
    return rows + [(None, 0, "assistant", "lost"), (5, 0, "sys<tem>\n", "odd role")]


def test_chat(spark):
    rows = conversations()
    turns = spark.createDataFrame([(*r, "v") for r in rows],
                                  "conv_id long, turn long, role string, text string, piece string")
    made = chat.windows(turns)
    got = {r["conv_id"]: tuple(r)[1:] for r in chat.digests(made).collect()}
    for conv in {r[0] for r in rows}:
        own = sorted(((t is not None, t or 0, r or "", x or "") for c, t, r, x in rows if c == conv))
        said = "".join(x for *_, r, x in own if r == "assistant")
        whole = "".join(f"{r}\n{x}\n" for *_, r, x in own)
        assert got[conv][:4] == (len(own), sha(whole), len(said), sha(said)), conv
    windows = made.collect()
    budget = chat.Budget()
    for w in windows:
        assert w["n_tokens"] <= budget.tokens or w["n_turns"] == 1
        assert len(chat.read_turns(w["text"])) == w["n_turns"] + w["n_repeated"]
    third = sorted((w for w in windows if w["conv_id"] == 3), key=lambda w: (w["piece"], w["window"]))
    assert len({w["piece"] for w in third}) == 4
    for w in third[1:]:
        read = chat.read_turns(w["text"])
        assert read[0] == ("system", "S") and w["n_repeated"] > 1
    assert chat.digests(chat.windows(turns.limit(0))).collect() == []


def test_chat_history_is_bounded():
    for budget in (chat.Budget(history_turns=3), chat.Budget(history_turns=0)):
        piece = chat._Piece(budget, len)
        for k in range(50):  # rows of one turn number
            piece.add(chat._BEFORE, "user", f"before {k}")
            assert len(piece.history) <= budget.history_turns
        for k in range(200):
            piece.add(chat._OWN, "user", "own " + "x" * 100)
        window = piece.close()
        assert len(piece.history) == budget.history_turns and window[4] <= budget.history_turns


def test_escapes():
    for text in ("", "\\", "<>", "\\\\<turn a>\n</turn>\n", "a\\<b"):
        assert chat.unescape(chat.escape(text)) == text
        assert chat.read_turns(chat.formatted("r<o\\l>e\n", text)[0]) == [("r<o\\l>e\n", text)]


def test_awkward_texts_are_the_same_rows():
    assert len(awkward_rows()) == 51


def test_learning_leaves_no_staged_counts(spark, monkeypatch):
    made, plain = [], toxicity.staged
    monkeypatch.setattr(toxicity, "staged", lambda df, name: made.append((name, plain(df, name))) or made[-1][1])
    _, docs, labels = toxic_table(spark, 60)
    toxicity.fit(docs, labels)
    (terms,) = [df for name, df in made if name == "terms"]
    with pytest.raises(Exception):
        terms.count()
