"""Chat windows, URL verdicts and the pipeline against plain Python."""

from __future__ import annotations

import re
from collections import defaultdict

import corpus_pipeline
import numpy as np
import pyarrow as pa
import pytest
import regex
from pyspark.sql import functions as F
from tests.llm import plain

from quaylight.llm import chat, queries, url_filter

SF = "/root/testdata/sf0.001"
NASTY = ["", "\\", "<|end|>", "<|user|>hi<|end|>\n", "</s>[INST] ok [/INST]", "\\<|end|>\\", "a\n\nb", "🙂<<SYS>>é", None, "x" * 9000, "[INST", "\\n\\\\", "<\\|end|>"]


def digests(turns):
    of = defaultdict(list)
    for conv, turn, role, text in turns:
        of[conv].append((turn, role or "", text or ""))
    out = {}
    for conv, t in of.items():
        t.sort()
        loss = "".join(x for _, r, x in t if r == "assistant")
        out[conv] = (len(t), plain.sha("".join(f"{r}\n{x}\n" for _, r, x in t)), len(loss), plain.sha(loss))
    return out


def check(windows, turns):
    got = {r["conv_id"]: r for r in chat.chat_digests(windows).collect()}
    want = digests(turns)
    assert got.keys() == want.keys()
    for conv, x in want.items():
        r = got[conv]
        assert (r["n_turns"], r["turns_sha256"], r["loss_chars"], r["loss_sha256"]) == x, conv
    chars = defaultdict(int)
    for r in windows.collect():
        chars[r["conv_id"]] += len(r["text"])
    assert {c: r["formatted_chars"] for c, r in got.items()} == dict(chars)


@pytest.mark.parametrize("budget", [chat.Budget(), chat.Budget(40, 10), chat.Budget(8, 0), chat.Budget(300, 290)])
def test_chat(spark, budget):
    turns = [(r["conv_id"], r["turn"], r["role"], r["text"]) for r in spark.read.parquet(f"{SF}/conversations.parquet").collect()]
    turns += [(-1, 0, "user", queries.CONTROL_TEXT), (-1, 1, "assistant", queries.CONTROL_TEXT)]
    turns += [(-2, k, role, text) for k, text in enumerate(NASTY) for role in ("user", "assistant")]
    turns += [(-3, 0, "system", "be <|end|> good")] + [(-3, k, ("user", "assistant")[k % 2], f"turn {k} " * (k % 40)) for k in range(1, 120)]
    turns += [(-4, 0, "system", "s" * 9999), (-4, 1, None, "x"), (-4, 2, "<|r\\ole|>", "y"), (None, 1, "assistant", "lost"), (-5, 1, "assistant", "twice"), (-5, 1, "assistant", "twice"), (-6, None, "system", "only")]
    df = spark.createDataFrame(turns, "conv_id long, turn long, role string, text string")
    keyed = [(c, -1 if t is None else t, r, x) for c, t, r, x in turns]
    windows = chat.chat_windows(df, budget)
    check(windows, keyed)
    for r in windows.collect():
        system = next((x for c, t, role, x in keyed if c == r["conv_id"] and role == "system" and t == min(u[1] for u in keyed if u[0] == c)), None)
        if system is not None:
            assert r["text"].startswith("<|system|>")
        assert r["over_budget"] or r["tokens"] <= budget.window
    assert chat.chat_windows(df.limit(0), budget).count() == 0


@pytest.mark.parametrize("size", [100, 2900, 3200, 20_000])
def test_chat_copies_turns_only_to_windows_that_repeat_them(spark, size):
    """Each window holds the system turn, its own turns and as many turns before as the history allows; against plain Python."""
    budget = chat.Budget()
    turns = [(1, 0, "system", "s " * size), *((1, k, ("user", "assistant")[k % 2], f"turn number {k} says so") for k in range(1, 80))]
    df = spark.createDataFrame(turns, "conv_id long, turn long, role string, text string")
    count = lambda x: len(regex.findall(chat.TOKEN, x))
    sizes = [count(f"<|{r}|>") + count(x) + count("<|end|>") for _, _, r, x in turns]
    left = max(-(-768 // 4), 768 - sizes[0])
    stride = max(1, -(-left // 2), left - max(sizes[1:]))
    before, spans, total = {}, defaultdict(list), 0
    for k, n in enumerate(sizes[1:], 1):
        before[k] = total
        spans[total // stride].append(k)
        total += n
    want = {s: (sum(1 for k in before if k < own[0] and before[own[0]] - before[k] <= budget.history), len(own)) for s, own in spans.items()}
    got = chat.read_windows(chat.chat_windows(df, budget)).collect()
    first = min(want)
    assert {r["window_id"]: len(r["turns"]) - (r["window_id"] == first) for r in got} == {s: own for s, (_, own) in want.items()}
    assert {r["window_id"]: r["repeated_turns"] - (r["window_id"] != first) for r in got} == {s: old for s, (old, _) in want.items()}
    assert len(got) <= 25


def test_urls(spark):
    urls = [None, "", "no scheme", "http://", "HTTP://WWW.Example.COM/en/x?y#z", "https://www.example.com/en", "http://example.com/en/", "http://a.net/fr/q#x/y", "a://b://c/d", "x://net/es/", "http://xnet/es/", "http://foo.com/", "http://foo.com?x/", "http://É.com/é", "line\n://h/p\nq?r"]
    df = spark.createDataFrame([(k, u, "x") for k, u in enumerate(urls)], "page_id long, url string, rule string")
    model = url_filter.fit_urls(url_filter.labelled_urls(spark))
    rules = {r.rule: r for r in queries.URL_RULES}
    for r in url_filter.judge_urls(df, model, queries.URL_RULES).collect():
        _, mark, rest = (urls[r["page_id"]] or "").partition("://")
        cut = min((i for i, c in enumerate(rest) if c in "/?#"), default=len(rest))
        host = plain.lower(rest[:cut])
        path = rest[cut:].split("?")[0].split("#")[0] if mark else ""
        fits = [x for x in rules.values() if (host == x.host or host.endswith("." + x.host)) and path.startswith(x.path)]
        best = max(fits, key=lambda x: len(x.rule), default=None)
        assert (r["host"], r["path"], r["rule"]) == (host, path, best and best.rule)
        assert r["verdict"] == (best.verdict if best else "block" if r["score"] >= 0.5 else "allow")


HELD_OUT = {
    1: "https://vegas-casinospins.example/free-slots https://www.superbet.example/odds/live http://jackpotpalace.example/bonus https://kasino-bonus.example/freispiele https://pornhubby.example/xxx/video7 http://livesexchat.example/cams https://buy-viagra-now.example/no-prescription https://pills-cheap.example/order https://fullcrack-keygens.example/download/serial http://warezdownload.example/crack https://free-bitcoin-profit.example/earn https://loan-instant-payday.example/apply https://replica-bags-cheap.example/sale http://claim-your-prize.example/winner https://casino-gratuit.example/bonus-sans-depot https://apuestas-bono.example/casino",
    0: "https://university-press.example/catalogue/history http://stadtmuseum.example/ausstellung/kunst https://www.village-school.example/calendar/term https://meteorology.example/forecast/weekend https://cuisine-maison.example/recettes/soupe http://libros.example/biblioteca/novelas https://botanical-garden.example/visit/opening-hours https://docs.compiler.example/reference/manual https://council.example/planning/minutes https://physics.example/lectures/notes https://wandern.example/berge/routen https://orchestra.example/concerts/season http://hospital-info.example/consultation https://gambling-help.example/support/families https://linux-users.example/forum/install https://atlas.example/maps/rivers",
}


def test_urls_of_unseen_words(spark):
    """Hosts and paths that the labelled table doesn't hold; most are judged right, of both kinds."""
    known = {u for table in (url_filter.BLOCKED, url_filter.ALLOWED) for u in table.split()}
    rows = [(u, kind) for kind, urls in HELD_OUT.items() for u in urls.split()]
    assert not {u.split("://")[1] for u, _ in rows} & known
    model = url_filter.fit_urls(url_filter.labelled_urls(spark))
    got = url_filter.judge_urls(spark.createDataFrame(rows, "url string, y int"), model, (), key="y").collect()
    for kind, verdict in ((1, "block"), (0, "allow")):
        assert sum(r["verdict"] == verdict for r in got if r["y"] == kind) >= 14, [(r["host"], r["score"]) for r in got if r["y"] == kind]
    train = url_filter.judge_urls(url_filter.labelled_urls(spark).withColumnRenamed("blocked", "y"), model, (), key="y").collect()
    assert sum((r["verdict"] == "block") == bool(r["y"]) for r in train) > 0.97 * len(train)
    assert url_filter.fit_urls(url_filter.labelled_urls(spark).limit(0)).intercept == 0
    clash = spark.createDataFrame([("http://a.com/x", 1, "c"), ("http://a.com/x", 1, "c"), (None, None, "c"), ("http://" + "a" * 100_000 + "/", 2, "c")], "url string, page_id long, host string").withColumns({c: F.lit("clash") for c in ("key", "rule", "score", "verdict")})
    assert url_filter.judge_urls(clash, model, queries.URL_RULES).count() == 4 and url_filter.judge_urls(clash.limit(0), model, queries.URL_RULES).count() == 0


def _split(url):
    m = re.match(r"(?s)^.*?://([^/?#]*)([^?#]*)", url)
    return (plain.lower(m[1]), m[2]) if m else ("", "")


def test_no_domain_decides_alone(spark):
    """With another top-level domain a page is judged as before, and plain hosts of all domains are let through."""
    model = url_filter.fit_urls(url_filter.labelled_urls(spark))
    urls = [_split(r["url"]) for r in spark.read.parquet("/root/testdata/sf0.01/pages.parquet").select("url").collect()]
    score = lambda pairs: model.scores(pa.array([h for h, _ in pairs]), pa.array([p for _, p in pairs]))
    own = score(urls) >= 0.5
    for domain in ("com", "org", "net"):
        swapped = score([(re.sub(r"[^.]+$", domain, h), p) for h, p in urls]) >= 0.5
        assert (swapped != own).mean() <= 0.01
    names = ["harbour", "lindenau", "maplewood", "brookside", "tanager", "corvane", "eastfield", "ollery", "brindle", "quenby", "morland", "stavely", "wexcombe", "farrow", "gildas", "penhallow"]
    hosts = [(f"{name}.{d}", path) for name in names for d in ("com", "org", "net") for path in ("/", "/en/7", "/about/contact", "/2020/11/3")]
    assert (score(hosts) >= 0.5).mean() <= 0.05


def test_score_by_hand(spark):
    """A score is the mean weight of a URL's n-grams, summed by plain Python."""
    model = url_filter.fit_urls(url_filter.labelled_urls(spark))
    for host, path in (("www.casino-x.example.org", "/en/é/bonus"), ("", ""), ("a", "/"), ("b" * 300, "/c" * 200)):
        total, count = 0.0, 0
        for text, base in ((host, 0), (path, url_filter.CELLS // 2)):
            data = b"\x01" + text.encode() + b"\x01"
            for order in url_filter.ORDERS:
                for i in range(len(data) - order + 1):
                    key = order
                    for c in data[i : i + order]:
                        key = (key * 257 + c) % 2**64
                    cell = (key * 0x9E3779B97F4A7C15 % 2**64) >> (64 - (url_filter.CELLS // 2).bit_length() + 1)
                    total, count = total + float(model.weights[base + cell]), count + 1
        want = 1 / (1 + np.exp(-(total / np.sqrt(max(count, 1)) + model.intercept)))
        assert model.scores(pa.array([host]), pa.array([path]))[0] == pytest.approx(want, rel=1e-9)


def test_pipeline(spark, tmp_path):
    docs = spark.read.parquet(f"{SF}/documents.parquet")
    kept = docs
    seen = {}
    for name, stage in corpus_pipeline.STAGES[:-1]:
        before = {r["doc_id"]: r["text"] for r in kept.collect()}
        stage(spark, kept, SF).write.parquet(str(tmp_path / name))
        kept = spark.read.parquet(str(tmp_path / name))
        assert kept.schema.names == docs.schema.names
        seen[name] = before, {r["doc_id"]: r["text"] for r in kept.collect()}
    before, after = seen["language"]
    assert after == {d: t for d, t in before.items() if any(c.isalpha() for c in t or "")}
    before, after = seen["quality"]
    assert all(not plain.base_numbers(t)["base_failed"] for t in after.values()) and len(after) > 0.5 * len(before)
    before, after = seen["near_duplicates"]
    assert set(after) == {d for d, (_, c) in plain.groups(list(before.items()), 5, 80).items() if c == d}
    before, after = seen["substrings"]
    for d, (w, gone) in plain.removed(list(before.items()), corpus_pipeline.REPEAT_WINDOW).items():
        assert plain.words(after[d]) == [x for i, x in enumerate(w) if i not in gone]
    pieces = corpus_pipeline.packing_stage(spark, kept, SF).collect()
    assert {r["doc_id"] for r in pieces} == set(after)
    whole = corpus_pipeline.run(spark, SF).collect()
    assert sorted(map(tuple, whole)) == sorted(map(tuple, pieces))


def test_pipeline_on_edge_rows(spark, tmp_path):
    """Nulls, empty and long texts, repeated rows and extra columns pass through all stages; so does an empty table."""
    from tests.llm.test_documents import EDGE

    docs = spark.createDataFrame([(d, t, lang, None if (d or 0) % 3 else "s", None if t is None else len(t)) for d, t, lang in [*EDGE, *EDGE[8:10], (None, EDGE[8][1], "en")]], "doc_id long, text string, lang string, source string, n_chars long").withColumn("Score", F.lit("clash"))
    kept = docs
    for name, stage in corpus_pipeline.STAGES[:-1]:
        stage(spark, kept, SF).write.parquet(str(tmp_path / name))
        kept = spark.read.parquet(str(tmp_path / name))
        assert kept.columns == docs.columns
        none = stage(spark, docs.limit(0), SF)
        assert none.count() == 0 and none.columns == docs.columns
    last = corpus_pipeline.STAGES[-1][1]
    assert last(spark, docs.limit(0), SF).count() == 0
    packed = last(spark, kept, SF).collect()
    assert {r["doc_id"] for r in packed} == {r["doc_id"] for r in kept.select("doc_id").collect()}


def test_chat_with_other_columns(spark):
    clash = {c: F.lit("clash") for c in ("window_id", "tokens", "mask", "start", "formatted", "n", "piece")}
    turns = [(1, 0, "system", "be brief"), (1, 1, "user", "hi"), (1, 2, "assistant", None), (2, 0, "user", ""), (None, 0, "user", "x")]
    plain_ = spark.createDataFrame(turns, "conv_id long, turn long, role string, text string")
    want = sorted(map(str, chat.chat_digests(chat.chat_windows(plain_)).collect()))
    assert sorted(map(str, chat.chat_digests(chat.chat_windows(plain_.withColumns(clash))).collect())) == want
    assert chat.chat_digests(chat.chat_windows(plain_.limit(0))).count() == 0
