"""Jaccard join, neighbours, reply trees, pages and URLs against plain versions of themselves."""

import collections
import os
import random
import re

import numpy as np
import pyarrow as pa
import pytest

from fencewatch.llm import chat, dom, jaccard, neighbours, pages, trie, urls
from fencewatch.llm.queries import _TRICKY, ORACLES, QUERIES, URL_RULES
from tests.llm.cases import DATA, WORDS, odd_documents, random_text, with_clashes


# --- Jaccard join


def _plain_components(rows):
    sets = []
    for doc_id, text in rows:
        lower = "".join(c.lower() if "A" <= c <= "Z" else c for c in text or "")
        words = re.findall(r"[^\x20\x09-\x0D]+", lower)
        sets.append((doc_id, {tuple(words[i : i + 5]) for i in range(max(1, len(words) - 4))} if words else set()))
    root = list(range(len(sets)))

    def find(x):
        while root[x] != x:
            x = root[x]
        return x

    for i, (_, a) in enumerate(sets):
        for j, (_, b) in enumerate(sets[:i]):
            if a and b and 100 * len(a & b) >= 80 * len(a | b):
                root[find(i)] = find(j)
    groups = {}
    for i, (doc_id, s) in enumerate(sets):
        if doc_id is not None:
            groups.setdefault(find(i), []).append(doc_id)
    return [(doc_id, len(s), min(groups.get(find(i), [doc_id]), default=None)) for i, (doc_id, s) in enumerate(sets)]


def _near_copies():
    draw = random.Random(8)
    rows, number = [], 100
    passage = random_text(draw, 60)
    for _ in range(12):
        base = [f"{draw.choice(WORDS)}{draw.randint(0, 9)}" for _ in range(draw.randint(5, 140))]
        for _ in range(draw.choice([1, 2, 6])):
            words = base[:]
            for _ in range(draw.choice([0, 1, 2, 4])):
                words[draw.randrange(len(words))] = draw.choice(WORDS)
            rows.append((number, " ".join(words).upper() if draw.random() < 0.2 else " ".join(words)))
            number += 1
    # Texts that share most of a passage, some alike and some not.
    for extra in (0, 3, 10, 20, 40):
        rows += [(number + extra, passage + " " + random_text(draw, extra)), (number + 50 + extra, random_text(draw, extra) + " " + passage)]
    return rows


_SMALL = dict(unit=150, sample=20, frequent=2, overlap=1, share=1000, block=3)


@pytest.mark.parametrize("rule", [jaccard.JaccardRule(), jaccard.JaccardRule(**_SMALL), jaccard.JaccardRule(**_SMALL, blocks=0)])
def test_components_equal_those_of_all_pairs(spark, rule):
    rows = _near_copies() + odd_documents()
    got = jaccard.near_duplicates(with_clashes(spark, rows, "doc_id long, text string"), rule).collect()
    key = lambda r: (r[0] is None, r[0] or 0, r[1], r[2] or 0)
    assert sorted((tuple(r) for r in got), key=key) == sorted(_plain_components(rows), key=key)


def test_one_document_of_each_component_stays(spark):
    rows = _near_copies() + odd_documents()
    frame = with_clashes(spark, rows, "doc_id long, text string")
    stays = jaccard.distinct_documents(frame)
    assert stays.columns == frame.columns
    wanted = sorted(str(i) for i, n, c in _plain_components(rows) if n == 0 or i is None or i == c)
    assert sorted(str(r["doc_id"]) for r in stays.collect()) == wanted
    assert jaccard.distinct_documents(frame.where("false")).count() == 0


def test_texts_of_one_id_stay_or_go_each_by_itself(spark):
    draw = random.Random(9)
    copied, clean = random_text(draw, 30), random_text(draw, 30)
    rows = [(1, copied), (2, copied), (2, clean), (3, "a text of its own with some words"), (2, None)]
    stays = jaccard.distinct_documents(with_clashes(spark, rows, "doc_id long, text string")).collect()
    assert sorted((r["doc_id"], r["text"] or "") for r in stays) == sorted((i, t or "") for i, t in rows if (i, t) != (2, copied))


def test_trie_search_equals_all_pairs():
    draw = random.Random(1)
    for _ in range(200):
        base = [set(draw.sample(range(40), draw.randint(1, 20))) for _ in range(2)]
        sets = []
        for _ in range(draw.randint(1, 12)):
            s = set(draw.choice(base))
            for _ in range(draw.randint(0, 3)):
                s ^= {draw.randint(0, 50)}
            sets.append(s or {1})
        rows = [(i, i, np.array(sorted(s), np.uint64)) for i, s in enumerate(sets)]
        found = trie.SetTrie([r[2] for r in rows])
        none = np.full(len(rows), -1)
        for i, _, numbers in rows:
            hits = {found.order[r] for r in found.search(numbers, i, none, np.zeros(len(found._low), bool))}
            assert hits == {j for j, s in enumerate(sets) if 100 * len(s & sets[i]) >= 80 * len(s | sets[i])}


# --- neighbours


def _plain_nearest(rows, k=10):
    good = {(i, tuple(v)) for i, v in rows if i is not None and v and all(x is not None and np.isfinite(x) for x in v) and any(v)}
    out = []
    for q, v in good:
        if q % 100 == 0:
            near = {(float(np.sqrt(((np.array(v) - np.array(w)) ** 2).sum())), i) for i, w in good if i != q and len(w) == len(v)}
            out += [(q, n + 1, i, s) for n, (s, i) in enumerate(sorted(near)[:k])]
    return sorted(out)


def test_neighbours_equal_brute_force_on_few_rows(spark):
    from pyspark.sql import functions as F

    draw = random.Random(6)
    rows = [(i, [draw.choice([-1.0, 0.5, 2.0]) for _ in range(4)]) for i in range(230)]
    rows += [(300, None), (400, [0.0] * 4), (500, [1.0, None, 1.0, 1.0]), (600, [float("nan"), 1.0, 1.0, 1.0])]
    rows += [(700, [float("inf"), 1.0, 1.0, 1.0]), (None, [1.0] * 4), (800, [1.0, 2.0]), (801, [1.5, 2.0]), rows[0], rows[5]]
    frame = with_clashes(spark, rows, "vec_id long, embedding array<double>")
    got = sorted(tuple(r) for r in neighbours.nearest(frame, F.col("vec_id") % 100 == 0).collect())
    wanted = _plain_nearest(rows)
    assert [r[:3] for r in got] == [r[:3] for r in wanted]
    assert np.allclose([r[3] for r in got], [r[3] for r in wanted], rtol=0, atol=1e-12)
    assert neighbours.nearest(frame.where("false"), F.col("vec_id") % 100 == 0).count() == 0


def test_hilbert_neighbours_on_the_curve_touch():
    cells = np.array(np.meshgrid(*[np.arange(8)] * 3)).reshape(3, -1).T
    order = cells[np.argsort(neighbours.hilbert_keys(cells, 3))]
    assert sorted(neighbours.hilbert_keys(cells, 3)) == list(range(512))
    assert (np.abs(np.diff(order, axis=0)).sum(1) == 1).all()


def test_small_blocks_find_clustered_neighbours(spark):
    from pyspark.sql import functions as F

    draw = np.random.default_rng(2)
    centres = draw.normal(size=(60, 16)) * 5
    rows = [(i, (centres[i % 60] + draw.normal(size=16)).tolist()) for i in range(3000)]
    frame = spark.createDataFrame(rows, "vec_id long, embedding array<double>")
    got = neighbours.nearest(frame, F.col("vec_id") % 100 == 0, curves=neighbours.Curves(block=128)).collect()
    wanted = {r[:1] + r[2:3] for r in _plain_nearest(rows)}
    assert len({(r["query_id"], r["vec_id"]) for r in got} & wanted) >= 0.9 * len(wanted)


@pytest.mark.parametrize("most", [65536, 40])
def test_window_follows_from_the_number_of_rows(spark, most):
    from pyspark.sql import functions as F

    # Without structure, a window of a fixed number of rows loses most neighbours.
    vectors = np.random.default_rng(3).normal(size=(6000, 64))
    vectors /= np.linalg.norm(vectors, axis=1, keepdims=True)
    frame = spark.createDataFrame([(i, v.tolist()) for i, v in enumerate(vectors)], "vec_id long, embedding array<double>")
    curves = neighbours.Curves(block=8, most=most)
    got = neighbours.nearest(frame, F.col("vec_id") % 100 == 0, curves=curves).collect()
    hits = 0
    for q in range(0, 6000, 100):
        near = np.argsort(((vectors - vectors[q]) ** 2).sum(1))[1:11].tolist()
        hits += len({r["vec_id"] for r in got if r["query_id"] == q} & set(near))
    assert hits >= 0.9 * 600


def test_nearest_of_huge_and_tiny_numbers_equal_those_of_a_loop():
    draw = np.random.default_rng(4)
    for scale in (1e200, 1e-200, 1.0, 1e6):
        vectors = (draw.integers(-2, 3, size=(300, 5)) + (1e6 if scale == 1.0 else 0)) * scale
        ids = draw.permutation(300)
        for vector, (places, score) in zip(vectors[:40], neighbours._nearest_of(vectors, vectors[:40], ids, 11)):
            with np.errstate(over="ignore"):
                wanted = np.sqrt(((vectors - vector) ** 2).sum(1))
            near = np.lexsort((ids, wanted))[:11]
            assert places.tolist() == near.tolist() and score.tolist() == wanted[near].tolist()


# --- reply trees


def test_template_is_reversible():
    draw = random.Random(1)
    bits = ["[", "\\", "/INST]", "INST]", "<", "s>", "/s>", " ", "x", "\n", "ROLE]", "/TEXT]", " [/INST]", " </s>", _TRICKY]
    for _ in range(3000):
        turns = [
            (draw.choice(["user", "assistant", "system", "[ROLE]", "a b/é", ""]), "".join(draw.choice(bits) for _ in range(draw.randint(0, 8))))
            for _ in range(draw.randint(0, 5))
        ]
        text, mask = chat.formatted_turns(turns)
        assert chat.read_turns(text) == turns
        assert [chat.unescaped(text[a:b]) for a, b in mask] == [t for r, t in turns if r == "assistant"]


def _plain_paths(nodes, branches):
    trees = {}
    for tree, node, parent, role, text, score in nodes:
        if node is not None:
            row = (parent is not None, parent or 0, role or "", text or "", float(score or 0))
            trees.setdefault(tree, {})
            trees[tree][node] = min(trees[tree].get(node, row), row)
    out = []
    for tree, kept in trees.items():
        parents = {n: r[1] if r[0] and r[1] in kept else None for n, r in kept.items()}
        ranked = []
        for leaf in set(kept) - set(parents.values()):
            path, at = [], leaf
            while at is not None and len(path) <= len(kept):
                path.append(at)
                at = parents[at]
            if at is None:
                ranked.append((-sum(kept[n][4] for n in path), leaf, [(kept[n][2], kept[n][3]) for n in path[::-1]]))
        out += [(tree, leaf, i + 1, turns) for i, (_, leaf, turns) in enumerate(sorted(ranked)[:branches])]
    return sorted(out, key=repr)


def test_paths_equal_those_of_a_walk(spark):
    draw = random.Random(5)
    nodes = [(t, n, draw.choice([None, *range(n)]) if n else None, draw.choice(["user", "assistant", None]), draw.choice(["hi", None, _TRICKY]), draw.choice([1.0, 2.0, None])) for t in (1, 2, None) for n in range(25)]
    nodes += [(3, n, n - 1 if n else None, "user", str(n), 1.0) for n in range(70)]  # a long chain
    nodes += [(4, 1, 2, "user", "a", 1.0), (4, 2, 1, "user", "b", 1.0), (4, 3, 1, "user", "c", 1.0)]  # a cycle
    nodes += [(5, None, None, "user", "no id", 1.0), nodes[0], (1, 3, 0, "user", "another row", 0.0)]
    frame = with_clashes(spark, nodes, "tree_id long, node_id long, parent_id long, role string, text string, score double")
    got = chat.read_back(chat.conversations(frame, branches=3), ["tree_id", "leaf_id", "rank"]).collect()
    rows = [(r["tree_id"], r["leaf_id"], r["rank"], [tuple(t) for t in r["turns"]]) for r in got]
    assert sorted(rows, key=repr) == _plain_paths(nodes, 3)
    assert chat.conversations(frame.where("false")).count() == 0


# --- pages


def test_pages_laid_out_otherwise_are_read_right():
    model, layout, right = pages.trained(), pages._Layout(random.Random(321)), 0
    for _ in range(150):
        source = layout.page()
        main = source[source.index("<!--main-->") : source.index("<!--end-->")]
        wanted = dom.read_page(re.sub(r"<!--x-->.*?<!--y-->", "", main, flags=re.DOTALL))
        right += pages.main_text(source, model) == dom.joined(wanted, [True] * len(wanted.tag))
    assert right >= 140


@pytest.mark.skipif(not os.path.isdir(DATA), reason="test tables not there")
def test_articles_of_the_test_pages(spark):
    rows = pages.extracted(spark.read.parquet(f"{DATA}/pages.parquet").select("*")).collect()
    sources = {r["page_id"]: r["html"] for r in spark.read.parquet(f"{DATA}/pages.parquet").collect()}
    right = 0
    for r in rows:
        article = dom.read_page(re.search(r"<article>(.*)</article>", sources[r["page_id"]], re.DOTALL)[1])
        right += r["text"] == dom.joined(article, [True] * len(article.tag))
    assert right >= 0.95 * len(rows)


def test_share_of_like_siblings_counts_all_of_them():
    page = dom.read_page("<div>" + "<p>a</p>" * 90 + "<ul><li>b</ul>" * 30 + "</div>")
    share = pages.features(page, {})[:, 15]
    got = {(tag, share[i]) for i, tag in enumerate(page.tag) if tag in ("p", "ul")}
    assert got == {("p", 0.75), ("ul", 0.25)}


def test_no_node_contradicts_one_above():
    model, layout = pages.trained(), pages._Layout(random.Random(5))
    page = dom.read_page(layout.page())
    logit = np.full(len(page.tag), 3.0)
    assert all(pages.decoded(page, logit)) and not any(pages.decoded(page, -logit))
    assert len(model.trees.value) > 0


def test_markup_is_read_leniently():
    read = lambda s: dom.joined(p := dom.read_page(s), [True] * len(p.tag))
    assert read("<p>a<b>b</b> &amp;amp; c<br>d<p>e<li>f<li>g") == "ab &amp; c d e f g"
    assert read("<script>var t='</p>'</script>x<style>p{}</style><!-- <p>no</p> -->y<![CDATA[z]]>") == "xy"
    assert read("a < b <p class='x>y'>c</p></div></b> d <title>t</title>") == "a < b c d"
    assert read("<p>unclosed <a href='x>" + "y" * 1000) != "" and read("<" * 50_000) == "<" * 50_000


@pytest.mark.parametrize(
    "source, wanted",
    [
        ("<article><video src=x><p>a</p><p>b</p></article><p>c</p>", "a b c"),
        ("<article><p>a</p><audio><source src=x></p><p>b</p></article>", "a b"),
        ("<div><video>old browser</video>a<video src=x></div><video>no</video>b", "a b"),
        ("<p>a<svg><svg><text>x</text></svg><title>y</title></svg>b</p>", "ab"),
        ("<p>a<svg>b</p><p>c</p>", "ab c"),
        ("<p>a <math><mi>x</mi><mo>=</mo><mn>1</mn></math> b</p>", "a x=1 b"),
        ("<p>a <object data=x>b</object> <noscript>c</noscript> d</p>", "a b c d"),
        ("<p><object data=x>a</p><p>b</p>", "a b"),
        ("<p><noscript>a<p>b", "a b"),
        ("<article><iframe src=x><p>a</p></article>b", "a b"),
        ("<article><iframe src=x>no</iframe><p>a</p></article>b", "a b"),
        ("<div><div><canvas>a</div>b</div>c", "a b c"),
        ("<video><div>no</div></video>a", "a"),
        ("<div><video><div>no</div></video>a</div>", "a"),
        ("<p>a<textarea>b</p>c", "ab c"),
        ("<head><title>t<body>a", "ta"),
        ("<p>a<script>b</p>c", "a"),
        ("<p>a<style>b</p>c", "a"),
    ],
)
def test_hidden_elements_that_are_not_closed_hide_nothing_else(source, wanted):
    page = dom.read_page(source)
    assert dom.joined(page, [True] * len(page.tag)).replace(" ", "") == wanted.replace(" ", "")


def test_many_open_media_elements_take_linear_time():
    page = dom.read_page("<video src=x><p>a</p>" * 20_000)
    assert len(page.tag) == 20_001


def test_pages_without_text(spark):
    rows = [(1, None, None), (2, "u", ""), (None, "u", "<html><body><nav><a href=/>x</a></nav></body></html>"), (2, "u", "")]
    frame = with_clashes(spark, rows, "page_id long, url string, html string")
    assert [r["text"] for r in pages.extracted(frame).collect()][:2] == ["", ""]
    assert pages.extracted(frame.where("false")).count() == 0


# --- URLs


def test_parts_and_listed_rules(spark):
    wanted = {
        "https://A.Example.NET/en/1?x#y": ("a.example.net", "/en/1", "example.net/en/", "allow"),
        "http://example.net": ("example.net", "", None, "allow"),
        "http://x.net/fr/": ("x.net", "/fr/", "net/", "block"),
        "x://sub.example.com/de/4": ("sub.example.com", "/de/4", "example.com/de/", "block"),
        "x://notexample.com/de/4": ("notexample.com", "/de/4", None, "allow"),
        "x://b.org/fr/1://net/": ("b.org", "/fr/1://net/", "org/fr/", "allow"),
        "x://net?/": ("net", "", None, "allow"),
        "no scheme.net/": ("", "", None, "allow"),
        None: ("", "", None, "allow"),
        "": ("", "", None, "allow"),
    }
    frame = with_clashes(spark, [(i, u) for i, u in enumerate([*wanted, *wanted])], "page_id long, url string", ["bad", "items", "confidence"])
    nothing = spark.createDataFrame([], "url string, bad boolean")
    rows = urls.judged(frame, nothing, URL_RULES).join(frame, "page_id").collect()
    assert len(rows) == 2 * len(wanted)
    for r in rows:
        assert (r["host"], r["path"], r["rule"], r["verdict"]) == wanted[r["url"]]


def test_mined_rules_block_combinations_and_nothing_else(spark):
    def url(host, word, i):
        return f"http://{host}.example.org/{word}/{i}"

    rows = [(url(h, w, i), h == "deals" and w == "pills") for i in range(30) for h in ("deals", "blog") for w in ("pills", "news")]
    labelled = spark.createDataFrame(rows + [(None, True), ("http://x.org/", None)], "url string, bad boolean")
    mining = urls.Mining(support=0.05, confidence=0.9)
    rules = urls.mined_rules(labelled, mining).collect()
    assert rules and all({"path:pills"} <= set(r["antecedent"]) and any("deals" in t for t in r["antecedent"]) for r in rules)
    asked = [(i, url(h, w, 99)) for i, (h, w) in enumerate([("deals", "pills"), ("deals", "news"), ("blog", "pills"), ("x", "y")])]
    asked += [(4, None), (0, asked[0][1])]
    got = urls.judged(spark.createDataFrame(asked, "page_id long, url string"), labelled, [], mining).collect()
    assert sorted((r["page_id"], r["verdict"]) for r in got) == [(0, "block"), (0, "block"), (1, "allow"), (2, "allow"), (3, "allow"), (4, "allow")]


def _plain_rules(rows, mining):
    """Rules by trying every combination of tokens that stand for others."""
    import itertools

    bad = {}
    for url, b in rows:
        bad[url] = bad.get(url, False) or b
    tokens = {}
    for url in bad:
        scheme, rest = url.split("://")
        host, *path = rest.split("/")
        found = {"scheme:" + scheme, *("host:" + h for h in host.split("."))}
        found |= {"part:" + w for h in host.split(".") if "-" in h for w in h.split("-")}
        found |= {"path:" + w for part in path for w in part.split("-") if w and not w.isdigit()}
        for t in found:
            tokens.setdefault(t, set()).add(url)
    twins = {}
    for t in sorted(tokens):
        twins.setdefault(frozenset(tokens[t]), []).append(t)
    least = max(mining.support * len(bad), mining.least)
    single = {names[0]: urls for urls, names in twins.items() if len(urls) >= least}
    rules = {}
    for size in range(1, len(single) + 1):
        for names in itertools.combinations(sorted(single), size):
            held = frozenset.intersection(*(single[n] for n in names))
            n_bad = sum(bad[u] for u in held)
            if n_bad >= least and n_bad / len(held) >= mining.confidence:
                rules[frozenset(names)] = n_bad / len(held)
    kept = {r for r, c in rules.items() if not any(s < r and c < d + mining.gain for s, d in rules.items())}
    alone = {names[0]: names for names in twins.values()}
    return {(t,) for r in kept if len(r) == 1 for t in alone[next(iter(r))]} | {tuple(sorted(r)) for r in kept if len(r) > 1}


@pytest.mark.parametrize("least", [1, 4])
def test_mined_rules_equal_those_of_all_combinations(spark, least):
    draw = random.Random(least)
    words = ["pills", "win", "news", "deal", "blog"]
    rows = []
    for i in range(160):
        path = sorted(set(draw.choices(words, k=draw.randint(1, 3))))
        host = draw.choice(["a-b.org", "shop.net", "x.shop.net"])
        rows.append((f"http://{host}/{'-'.join(path)}/{i}", draw.random() < (0.9 if {"pills", "win"} <= set(path) else 0.15)))
    rows += rows[:20]
    mining = urls.Mining(support=0.02, least=least, confidence=0.6)
    rules = urls.mined_rules(spark.createDataFrame(rows, "url string, bad boolean"), mining).collect()
    assert {tuple(r["antecedent"]) for r in rules} == _plain_rules(rows, mining) and len(rules) == len({tuple(r["antecedent"]) for r in rules})
    assert all(r["key"] in r["antecedent"] for r in rules)


def test_long_urls_and_few_labels_are_mined_in_bounded_work(spark):
    long = "/".join(f"word{'abcdefghij'[i % 10]}{'klmno'[i // 10]}" for i in range(40))
    rows = [(f"http://h.org/{long}/{i}", True) for i in range(30)] + [(f"http://g.org/b/{i}", False) for i in range(30)]
    rules = urls.mined_rules(spark.createDataFrame(rows, "url string, bad boolean"), urls.Mining()).collect()
    assert {tuple(r["antecedent"]) for r in rules if "scheme:http" not in r["antecedent"]} >= {("host:h",)} | {(f"path:{w}",) for w in long.split("/")}
    assert len(rules) < 100
    few = [(f"http://{i}.org/{long}", i % 2 == 0) for i in range(9)]
    assert urls.mined_rules(spark.createDataFrame(few, "url string, bad boolean"), urls.Mining()).count() == 0


@pytest.mark.skipif(not os.path.isdir(DATA), reason="test tables not there")
def test_url_query_has_no_python_in_its_plan(spark):
    plan = QUERIES["op8_url_rules"](spark, DATA)._jdf.queryExecution().toString()
    assert not re.search("Python|Arrow|Pandas", plan)


@pytest.mark.skipif(not os.path.isdir(DATA), reason="test tables not there")
@pytest.mark.parametrize("name", sorted(ORACLES))
def test_queries_equal_their_sql(spark, name):
    from tests.oracle_check import compare, connect

    assert compare(spark, connect(DATA), name, DATA) is None


@pytest.mark.parametrize("rule", [jaccard.JaccardRule(words=1, sample=20, frequent=2), jaccard.JaccardRule(words=1, frequent=60)])
def test_frequent_word_sequences_are_counted_in_every_text(spark, rule):
    draw = random.Random(3)
    rows = [(i, " ".join(f"w{int(draw.paretovariate(0.7))}" for _ in range(12))) for i in range(300)] + [(300, None), (301, "")]
    documents = spark.createDataFrame(rows, "doc_id long, text string").repartition(4)
    held = collections.Counter(word for _, text in rows for word in set((text or "").split()))
    got = jaccard.frequencies(documents, rule)
    least = 31 if rule.sample == 20 else 60  # 302 texts
    wanted = {word: n for word, n in held.items() if n >= least}
    assert len(wanted) > 2 and sorted(got.counts.tolist()) == sorted(wanted.values())
    values = jaccard.shingles(pa.array(list(wanted)), 1)[0]
    assert got(values).tolist() == list(wanted.values())
