"""Chat formatting, HTML rendering and mixing."""

import collections
import json
import random
import re
from html.parser import HTMLParser

import numpy as np
import pytest

from tessella.llm import queries
from tessella.llm.chat_format import format_chats
from tessella.llm.html_text import html_text, render
from tessella.llm.mixing import capped_share, mix, rake, sums_here, sums_there

TURNS = "conv_id long, turn long, role string, text string, json string, place string"
SCHEMAS = {
    "add": {"properties": {"a": {"type": "integer"}, "b": {"type": ["integer", "number"]}}, "required": ["a", "b"], "additionalProperties": False},
    "say": {"properties": {"tone": {"type": "string", "enum": ["kind", "plain"]}, "to": {"type": "array"}}},
}


def call(i, name, args):
    return "<tool_call>" + json.dumps({"id": i, "name": name, "arguments": args}) + "</tool_call>"


@pytest.fixture(scope="module")
def chats(spark):
    rows = [
        (1, 0, "user", 'Add "two"\nnumbers ü', None, None),
        (1, 1, "assistant", "Sure " + call("c2", "add", {"b": "$call:c1", "a": 1}) + call("c1", "add", {"b": 2.5, "a": 1}) + " ok", None, None),
        (1, 5, "tool", json.dumps({"tool_call_id": "c2", "content": "4"}), None, None),
        (1, 4, "tool", json.dumps({"tool_call_id": "c1", "content": {"z": 1, "a": [1]}}), None, None),
        (1, 6, "tool", json.dumps({"tool_call_id": "zz", "content": "?"}), None, None),
        (1, 7, "assistant", call("c1", "say", {"tone": "rude", "to": "x", "z": None}), None, None),
        (2, 0, "assistant", call("a", "add", {"a": "$call:b", "b": 1}) + call("b", "add", {"a": "$call:a", "b": 1}) + call("n", "none", {}) + "<tool_call>{oops</tool_call>", None, None),
        (2, 1, "assistant", call("m", "add", {"a": "$call:gone", "c": 1}), None, None),
        (None, None, None, None, None, None),
        (3, 0, "tool", "not json", None, None),
        (4, 0, "user", "same", None, None),
        (4, 0, "user", "same", None, None),
    ]
    return spark.createDataFrame(rows, TURNS)


def test_chat_lines(chats):
    out = format_chats(chats, SCHEMAS).collect()
    assert len(out) == chats.count()
    for r in out:
        parsed = json.loads(r.json)
        assert json.dumps(parsed, sort_keys=True, separators=(",", ":"), ensure_ascii=False) == r.json
    one = sorted((r for r in out if r.conv_id == 1), key=lambda r: r.place)
    assert [(r.role, r.call_id) for r in one] == [("user", None), ("assistant", None), ("tool", "c1"), ("tool", "c2"), ("tool", "zz"), ("assistant", None)]
    assert json.loads(one[0].json)["content"] == 'Add "two"\nnumbers ü'
    said = json.loads(one[1].json)
    assert [c["id"] for c in said["tool_calls"]] == ["c1", "c2"] and said["content"] == "Sure  ok"
    assert one[1].linked and one[1].errors == ["type:b"] and one[1].n_calls == 2
    assert one[4].errors == ["orphan"] and not one[4].linked
    assert sorted(one[5].errors) == ["duplicate_id", "enum:tone", "type:to"]
    two = {r.turn: sorted(r.errors) for r in out if r.conv_id == 2}
    assert two[0] == sorted(["type:a", "cycle", "unanswered", "type:a", "cycle", "unanswered", "unknown_tool", "unanswered", "invalid_json", "missing_id", "unanswered"])
    assert two[1] == sorted(["missing:b", "type:a", "unknown:c", "unknown_reference", "unanswered"])
    odd = next(r for r in out if r.conv_id is None)
    assert odd.json == '{"content":"","role":"unknown"}'


def test_schemas_are_checked_in_depth(spark):
    schema = {"properties": {"at": {"type": "object", "properties": {"x": {"type": "number", "minimum": 0, "maximum": 9}, "tag": {"pattern": "^[a-z]+$", "const": "ab"}}, "required": ["x"], "additionalProperties": False}, "list": {"type": "array", "items": {"type": "integer"}}}}
    cases = [
        ({"at": {"x": 3.5, "tag": "ab"}, "list": [1, 2]}, []),
        ({"at": {"x": 12, "tag": "A1", "y": 0}, "list": [1, "b"]}, ["const:at.tag", "items:list", "maximum:at.x", "pattern:at.tag", "unknown:at.y"]),
        ({"at": {}}, ["missing:at.x"]),
        ({"at": 5}, ["type:at"]),
        ({"at": {"x": -1}}, ["minimum:at.x"]),
    ]
    rows = [(1, i, "assistant", call(f"c{i}", "go", args)) for i, (args, _) in enumerate(cases)] + [(1, 99, "assistant", "well <tool_call>{")]
    got = {r.turn: sorted(set(r.errors) - {"unanswered"}) for r in format_chats(spark.createDataFrame(rows, "conv_id long, turn long, role string, text string"), {"go": schema}).collect()}
    assert got == {i: want for i, (_, want) in enumerate(cases)} | {99: ["unclosed_call"]}
    with pytest.raises(ValueError, match="can't check"):
        format_chats(spark.createDataFrame(rows, "conv_id long, turn long, role string, text string"), {"go": {"properties": {"a": {"oneOf": []}}}})


def test_the_query_checks_calls_against_its_tools(spark, tmp_path):
    said = [("search", {"query": "a", "limit": 5}), ("search", {"limit": 500}), ("convert", {"amount": 1.5, "unit": {"from": "m"}}), ("fly", {})]
    rows = [(1, 2 * i, "assistant", call(f"c{i}", *s)) for i, s in enumerate(said)]
    rows += [(1, 2 * i + 1, "tool", json.dumps({"tool_call_id": f"c{i}", "content": "ok"})) for i in range(len(said))]
    spark.createDataFrame(rows, "conv_id long, turn long, role string, text string").write.parquet(str(tmp_path / "conversations.parquet"))
    got = {r.turn: r.n_errors for r in queries.op7_chat_format(spark, str(tmp_path)).collect() if r.role == "assistant"}
    assert got == {0: 0, 2: 2, 4: 1, 6: 1}


def test_chat_runs_without_python(chats):
    plan = format_chats(chats, SCHEMAS)._jdf.queryExecution().toString()
    assert not re.search("Python|Arrow|Pandas", plan)


def test_chat_empty(chats):
    assert format_chats(chats.where("false")).count() == 0


@pytest.mark.parametrize(
    ("html", "want"),
    [
        ("", ""),
        ("plain &amp; simple", "plain & simple"),
        ("<p>a\n b<p>c</div>d", "a b\n\ncd"),
        ("<ul><li>x<li>y<ol start=3><li>n<li>m</ol><li>z</ul>", "- x\n- y\n  3. n\n  4. m\n- z"),
        ("<table><tr><th>Name<th>N<tr><td>long one<td>1<tr><td>s<td>22</table>", "Name      N\nlong one  1\ns         22"),
        ("<pre>a\n  b</pre>c", "a\n  b\n\nc"),
        ("a<script>if (x < 1) '</p>'</script>b<style>p{}</style><!-- no -->c", "abc"),
        ("<div hidden>no<p>no</div>yes<span style='color:red;display: none'>no</span><input type=hidden value=no>", "yes"),
        ("<title>no</title><h1>T</h1>text<br>line<hr>end", "T\n\ntext\nline\n---\nend"),
        ("<b>un<i>closed <p>x", "unclosed\n\nx"),
        ("<a title='hidden' href=x>link</a> <p class=\"display:none\">kept", "link\n\nkept"),
        ("<table><tr><td>a<br>b<td>c</table>", "a  c\nb"),
        ("1 < 2 and <3", "1 < 2 and <3"),
    ],
)
def test_render(html, want):
    assert render(html) == want


def test_render_is_robust():
    for bad in ["<a " * 500, "<div>" * 5000, "</p>" * 500, "<table><td>" * 300, "<!--", "<li>" * 1000, '<a b="' * 300]:
        render(bad + "end")
    assert render(None) is None
    assert render("<div>" * 3000 + "x") == "x"


@pytest.mark.parametrize(
    ("html", "want"),
    [
        ("a<svg>" + "<path d='M0 0'/>" * 3000 + "</svg>b", "ab"),
        ("a<svg viewBox='0'/>b<svg><use href=x/><style/><title/></svg>c<math><mi>x</mi><mspace/></math>d", "abcxd"),
        ("<svg>" + "<path d=M0/>" * 3000 + "</svg>b<svg><foreignObject><div/>in</div></foreignObject></svg>c<div/>d", "bc\nd"),
        ("a<div hidden>" + "<b>" * 5000 + "</div>b", "ab"),
        ("<p>a" + "<b>" * 3000 + "</p>b", "a\n\nb"),
        ("<ul><li>a" + "<b>" * 3000 + "<li>b</ul>", "- a\n- b"),
        ("<table><tr><td>a" + "<b>" * 3000 + "</p><td>b</table>c", "a  b\n\nc"),
    ],
)
def test_render_finds_open_elements_at_any_depth(html, want):
    assert render(html) == want


@pytest.mark.parametrize(
    "attrs",
    [
        "style='overflow:hidden'",
        'style="overflow-x: hidden; backface-visibility:hidden"',
        'aria-label="hidden costs" placeholder="hidden" onclick="this.hidden = 1"',
        "class=hidden data-hidden x-hidden='1'",
        'style="display:none; display:block"',
        """style="background:url('a;display:none'); --x-display:none" """,
        "hidden=false hidden",
        "aria-hidden=true",
        'title="a > b hidden"',
    ],
)
def test_what_is_visible(attrs):
    assert render(f"a<b {attrs}>b</b>c") == "abc"


@pytest.mark.parametrize(
    "attrs",
    ["hidden", "HIDDEN=''", "id=x hidden=hidden", "title='x'hidden", "style=display:none", "STYLE='color:red; Display : NONE !important; display:block'", "style='visibility:hidden;'", 'style="/* ; */display:none"', "style='display&colon;none'"],
)
def test_what_is_hidden(attrs):
    assert render(f"a<b {attrs}>b</b>c") == "ac"


@pytest.mark.parametrize(
    ("html", "want"),
    [
        ("a<div style='visibility:hidden'>no<b style=visibility:visible>yes</b>no<p hidden>no</p></div>z", "a\nyes\nz"),
        ("a<b style='display:none'>no<i style='visibility:visible'>no</i></b>z", "az"),
        ("<ol><li>a<li style='visibility:collapse'>no<li>c</ol>", "1. a\n3. c"),
        ("<table><tr><td rowspan=2>a<td>bb<td>c<tr><td>d<td>e<tr><td>f<td>g<td>h</table>", "a  bb  c\n   d   e\nf  g   h"),
        ("<table><tr><td colspan=2>wide head<td>x<tr><td>a<td>b<td>c</table>", "wide head  x\na  b       c"),
        ("<table><thead><tr><th rowspan=0>h<th>i<tr><th>j</thead><tbody><tr><td>k<td>l</table>", "h  i\n   j\nk  l"),
        ("<table><tr><td>a<table><tr><td>n<td>m</table><td>b</table>", "a     b\nn  m"),
        (f"<table><tr><td>{'x' * 500}<td>y<tr><td>z<td>w</table>", f"{'x' * 500}  y\nz{' ' * 201}w"),
    ],
)
def test_visibility_and_spans(html, want):
    assert render(html) == want


def test_lists_of_any_depth_keep_their_level():
    lines = render("".join(f"<ul><li>x{k}" for k in range(5000))).split("\n")
    assert len(lines) == 5000
    assert [line for line in lines[:61]] == [f"{'  ' * k}- x{k}" for k in range(61)]
    assert all(lines[k] == f"{'  ' * 60}({k}) - x{k}" for k in range(61, 5000))


class Plain(HTMLParser):
    """Visible words in order, for pages whose tags all are closed or void: a plain second way to read them."""

    def __init__(self):
        super().__init__(convert_charrefs=True)
        self.stack, self.words = [], []

    def handle_starttag(self, tag, attrs):
        own = {}
        for k, v in attrs:
            own.setdefault(k, v or "")
        style = dict(x.replace(" ", "").split(":", 1) for x in own.get("style", "").split(";") if ":" in x)
        gone, seen = self.stack[-1][1:] if self.stack else (False, True)
        gone |= tag in ("head", "script", "style", "template", "svg") or "hidden" in own or style.get("display") == "none"
        seen = {"hidden": False, "visible": True}.get(style.get("visibility"), seen)
        if tag not in ("br", "meta", "hr"):
            self.stack.append((tag, gone, seen))

    def handle_endtag(self, tag):
        while tag in [t for t, _, _ in self.stack]:
            if self.stack.pop()[0] == tag:
                break

    def handle_data(self, data):
        gone, seen = self.stack[-1][1:] if self.stack else (False, True)
        if seen and not gone:
            self.words.append(data)

    def result(self, html):
        self.feed(html)
        self.close()
        return "".join(self.words)


def squeezed(text):
    return re.sub(r"\s+", "", text)


def test_no_visible_text_is_lost_on_whole_pages(spark):
    rows = spark.read.parquet("/root/testdata/sf0.01/pages.parquet").collect()
    got = {r.page_id: r.text for r in html_text(spark.read.parquet("/root/testdata/sf0.01/pages.parquet")).collect()}
    assert len(got) == len(rows)
    for r in rows:
        # the only mark in these pages is the bullet of the navigation's items
        assert squeezed(re.sub(r"(?m)^- ", "", got[r.page_id])) == squeezed(Plain().result(r.html))


def tree(rnd, depth, number):
    """(html, visible words in order) of a random well-formed tree; words are numbered, so order and loss both show."""
    out, words = [], []
    for _ in range(rnd.randint(1, 4)):
        kind = rnd.choice(["text", "text", "div", "span", "p", "gone", "unseen", "list", "deep", "table", "script"] if depth else ["text"])
        if kind == "text":
            number[0] += 1
            out.append(f" w{number[0]} ")
            words.append((f"w{number[0]}", True))
        elif kind == "script":
            out.append("<script>var a = '<p>no';</script>")
        elif kind == "deep":
            html, inner = tree(rnd, depth - 1, number)
            k = rnd.choice([3, 300])
            out.append("<div>" * k + html + "</div>" * k)
            words += inner
        elif kind == "list":
            parts = [tree(rnd, depth - 1, number) for _ in range(rnd.randint(1, 3))]
            out.append("<ul>" + "".join(f"<li>{h}" + rnd.choice(["", "</li>"]) for h, _ in parts) + "</ul>")
            words += [w for _, ws in parts for w in ws]
        elif kind == "table":
            number[0] += 2
            out.append(f"<table><tr><td>w{number[0] - 1}<td rowspan=2>w{number[0]}</table>")
            words += [(f"w{number[0] - 1}", True), (f"w{number[0]}", True)]
        else:
            html, inner = tree(rnd, depth - 1, number)
            tag = "p" if kind == "p" and not re.search("<(p|div|ul|table)", html) else "span" if kind == "span" else "div"
            style = {"gone": " style='display: none'", "unseen": " style='visibility:hidden'"}.get(kind, "")
            out.append(f"<{tag}{style}>{html}</{tag}>")
            words += [(w, seen and kind not in ("gone", "unseen")) for w, seen in inner]
    return "".join(out), words


def test_generated_trees_show_their_words_in_order():
    rnd = random.Random(8)
    for _ in range(300):
        html, words = tree(rnd, 4, [0])
        assert re.findall(r"w\d+", render(html)) == [w for w, seen in words if seen]


def test_html_frame(spark):
    df = spark.createDataFrame([(1, "<p>a"), (1, "<p>a"), (None, None)], "page_id long, html string").selectExpr("*", "'t' as text", "'i' as id")
    assert sorted(map(tuple, html_text(df).collect()), key=str) == [(1, "a"), (1, "a"), (None, None)]
    assert html_text(df.where("false")).count() == 0


def test_rake_matches_marginals():
    rnd = np.random.default_rng(0)
    codes = [np.repeat(np.arange(5), 12), np.tile(np.repeat(np.arange(4), 3), 5), np.tile(np.arange(3), 20)]
    mass = rnd.random(60) + 0.1
    targets = [t / t.sum() for t in (rnd.random(5) + 0.2, rnd.random(4) + 0.2, rnd.random(3) + 0.2)]
    factors, miss = rake(sums_here(mass, codes), targets, mass.sum())
    w = factors[0][codes[0]] * factors[1][codes[1]] * factors[2][codes[2]]
    assert miss < 1e-6
    for code, target in zip(codes, targets, strict=True):
        assert np.allclose(np.bincount(code, mass / mass.sum() * w), target, atol=1e-6)


def test_capped_shares_meet_targets_and_keep_more():
    rnd = np.random.default_rng(3)
    codes = [np.repeat(np.arange(5), 12), np.tile(np.repeat(np.arange(4), 3), 5), np.tile(np.arange(3), 20)]
    mass = rnd.random(60) ** 3 + 0.001
    targets = []
    for c in codes:
        t = np.bincount(c, mass) ** 0.8
        targets.append(t / t.sum())
    sums = sums_here(mass, codes)
    factors, _ = rake(sums, targets, mass.sum())
    least = 1 / (factors[0][codes[0]] * factors[1][codes[1]] * factors[2][codes[2]]).max()
    share, factors, miss = capped_share(sums, targets, mass.sum(), least)
    p = np.minimum(1, share * factors[0][codes[0]] * factors[1][codes[1]] * factors[2][codes[2]])
    kept = mass * p
    assert miss <= 0.005 and (p == 1).any()
    for code, target in zip(codes, targets, strict=True):
        assert np.abs(np.bincount(code, kept) / kept.sum() - target).max() < 0.01
    assert kept.sum() / mass.sum() > 1.1 * least


def test_topics_are_clusters_of_words(spark):
    rnd = np.random.default_rng(0)
    fields = [[f"{f}{k}" for k in range(40)] for f in ("sea", "tax", "bird")]
    texts = [" ".join(rnd.choice(fields[i % 3], 30)) + " and the of" for i in range(300)]
    docs = spark.createDataFrame([(i, t, "en", "s") for i, t in enumerate(texts)] + [(900, " \n", "en", "s")], "doc_id long, text string, lang string, source string")
    got = {r.doc_id: r.mix_topic for r in mix(docs).collect()}
    assert got.pop(900) == "none"
    field_of = collections.defaultdict(set)
    for i, t in got.items():
        field_of[t].add(i % 3)
    assert all(len(f) == 1 for f in field_of.values()) and set().union(*field_of.values()) == {0, 1, 2}


def test_topics_are_fitted_on_all_texts(spark):
    """A language with a hundred of 12,000 texts has topics of its own, the same in any order of rows and tasks."""
    rnd = np.random.default_rng(1)
    words = {(lang, f): [f"{lang}{f}{k}" for k in range(20)] for lang, n in (("en", 6), ("xx", 3)) for f in range(n)}
    rows = [(i, " ".join(rnd.choice(words["en", i % 6], 12)), "en", "s") for i in range(12_000)]
    rows += [(20_000 + i, " ".join(rnd.choice(words["xx", i % 3], 12)), "xx", "s") for i in range(100)]
    schema = "doc_id long, text string, lang string, source string"
    once, again = ({r.doc_id: r.mix_topic for r in mix(spark.createDataFrame(x, schema).repartition(n)).collect()} for x, n in ((rows, 2), (rows[::-1], 5)))
    assert once == again
    field_of = collections.defaultdict(set)
    for i in range(100):
        field_of[once[20_000 + i]].add(i % 3)
    assert all(len(f) == 1 for f in field_of.values()) and set().union(*field_of.values()) == {0, 1, 2}


def plain_mix(rows, targets, temper=0.7):
    """Weights of (source, lang, topic) cells in plain Python, from rows (source, lang, topic, tokens)."""
    total = sum(r[3] for r in rows)
    weight = {r[:3]: 1.0 for r in rows}
    goals = []
    for k, name in enumerate(("source", "lang", "topic")):
        seen = collections.Counter()
        for r in rows:
            seen[r[k]] += r[3]
        if name in targets:
            given = {v: t for v, t in targets[name].items() if seen.get(v)}
            rest = {v: m for v, m in seen.items() if v not in given and m}
            left = max(0, 1 - sum(given.values())) if rest else 0
            goal = given | {v: left * m / sum(rest.values()) for v, m in rest.items()}
        else:
            goal = {v: m**temper for v, m in seen.items() if m}
        goals.append({v: g / sum(goal.values()) for v, g in goal.items()})
    for _ in range(200):
        worst = 0
        for k, goal in enumerate(goals):
            now = collections.Counter()
            for r in rows:
                now[r[k]] += r[3] * weight[r[:3]] / total
            worst = max([worst, *(abs(now[v] - g) for v, g in goal.items())])
            weight = {c: w * (goal.get(c[k], 0) / now[c[k]] if now[c[k]] else 1) for c, w in weight.items()}
        if worst < 1e-9:
            break
    return weight


def test_mix_is_the_plain_fit_on_whole_documents(spark):
    docs = spark.read.parquet("/root/testdata/sf0.01/documents.parquet")
    targets = {"lang": {"en": 0.4, "de": 0.2, "fr": 0.2, "es": 0.2}}
    rows = mix(docs, targets, with_text=False).collect()
    assert "text" not in rows[0].asDict()
    words = {r.doc_id: len(re.findall(r"[^\x20\x09-\x0D]+", r.text)) for r in docs.collect()}
    assert all(r.mix_n_tokens == words[r.doc_id] for r in rows)
    want = plain_mix([(r.source, r.lang, r.mix_topic, r.mix_n_tokens) for r in rows], targets)
    top = max(want.values())
    for r in rows:
        w = want[r.source, r.lang, r.mix_topic]
        assert r.mix_weight == pytest.approx(w, rel=1e-6) and r.mix_prob == pytest.approx(w / top, rel=1e-6)


def test_a_table_of_cells_is_fitted_like_cells_on_the_driver(spark):
    rnd = np.random.default_rng(1)
    codes = [rnd.integers(0, n, 500) for n in (40, 7, 5)]
    mass = rnd.random(500)
    targets = [t / t.sum() for t in (rnd.random(n) + 0.2 for n in (40, 7, 5))]
    cells = spark.createDataFrame(list(zip(*(c.tolist() for c in codes), mass.tolist(), strict=True)), "k0 long, k1 long, k2 long, mass double").repartition(3)
    for share in (None, 0.4):
        here, miss = rake(sums_here(mass, codes), targets, mass.sum(), share, rounds=2)
        there, gap = rake(sums_there(cells), targets, mass.sum(), share, rounds=2)
        assert gap == pytest.approx(miss, rel=1e-9) and miss > 1e-9
        assert all(np.allclose(a, b, rtol=1e-12) for a, b in zip(here, there, strict=True))


def test_capped_mix_meets_its_targets_on_whole_documents(spark):
    docs = spark.read.parquet("/root/testdata/sf0.1/documents.parquet")
    rows = mix(docs, capped=True, temper=0.9).select("source", "lang", "mix_topic", "mix_n_tokens", "mix_prob", "mix_kept").collect()
    expected = sum(r.mix_n_tokens * r.mix_prob for r in rows)
    sampled = sum(r.mix_n_tokens for r in rows if r.mix_kept)
    assert any(r.mix_prob == 1 for r in rows)
    for k in ("source", "lang", "mix_topic"):
        seen = collections.Counter()
        for r in rows:
            seen[r[k]] += r.mix_n_tokens
        raised = {v: m**0.9 for v, m in seen.items()}
        for v, m in raised.items():
            goal = m / sum(raised.values())
            assert sum(r.mix_n_tokens * r.mix_prob for r in rows if r[k] == v) / expected == pytest.approx(goal, abs=0.01)
            assert sum(r.mix_n_tokens for r in rows if r.mix_kept and r[k] == v) / sampled == pytest.approx(goal, abs=0.02)


def test_nulls_and_their_names_are_different_values(spark):
    rows = [(i, "a b c", lang, src) for i, (lang, src, n) in enumerate((la, s, n) for la, s, n in ((None, "x", 3), ("None", "x", 5), ("en", "y", 7), (None, "y", 2), ("en", None, 4)) for _ in range(n))]
    docs = spark.createDataFrame(rows, "doc_id long, text string, lang string, source string")
    targets = {"lang": {None: 0.3, "None": 0.3, "en": 0.4}}
    for cells in (100, 0):
        got = mix(docs, targets, columns=("lang",), driver_cells=cells).collect()
        for value, share in targets["lang"].items():
            assert sum(3 * r.mix_weight for r in got if r.lang == value) / (3 * len(got)) == pytest.approx(share, abs=1e-6)


def test_mix_tells_of_targets_that_cannot_be_met(spark):
    docs = spark.createDataFrame([(1, "a b", "en", "s"), (2, "c d", "de", "t")], "doc_id long, text string, lang string, source string")
    with pytest.warns(UserWarning, match="miss their targets by up to 0"):
        mix(docs, {"lang": {"en": 0.9, "de": 0.1}, "source": {"s": 0.1, "t": 0.9}}).collect()


def test_mix_edge_cases(spark):
    rows = [(1, "a b", None, "s"), (1, "a b", None, "s"), (None, None, "en", None), (2, "", "en", "s"), (3, "x\ty|z|  ", "en", "t")]
    docs = spark.createDataFrame(rows, "doc_id long, text string, lang string, source string").selectExpr("*", "1 as w", "2 as tokens", "3 as dim0", "'q' as m_key")
    for capped in (False, True):
        out = mix(docs, capped=capped)
        assert out.columns == [*docs.columns, *(f"mix_{c}" for c in ("topic", "n_tokens", "weight", "prob", "kept"))]
        got = out.collect()
        assert len(got) == 5 and len({r.mix_kept for r in got if r.doc_id == 1}) == 1
        assert {r.doc_id: r.mix_n_tokens for r in got} == {1: 2, None: 0, 2: 0, 3: 2}
        assert mix(docs.where("false"), capped=capped).count() == 0
    assert {r.mix_topic for r in mix(docs, topic_col="source").collect()} == {"s", "t", None}
