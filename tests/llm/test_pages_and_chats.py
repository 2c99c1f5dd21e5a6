from pyspark.sql import functions as F

from auditspark.llm import chat, html_text, urlgraph

RULES = [urlgraph.Rule("org", "/", "allow"), urlgraph.Rule("example.org", "/es/", "block"), urlgraph.Rule("example.org", "/en/1", "block"), urlgraph.Rule("com", "/fr/", "allow"), urlgraph.Rule("com", "/de/", "block")]


def test_rules_hosts_and_paths(spark):
    rows = [
        ("https://A.Example.ORG/es/x?y", "a.example.org", "/es/x", "example.org/es/", "block"), ("http://x.org", "x.org", "", None, "allow"), ("http://x.org/#a", "x.org", "/", "org/", "allow"),
        ("http://notexample.org/es/", "notexample.org", "/es/", "org/", "allow"), ("ftp://example.org/en/12", "example.org", "/en/12", "example.org/en/1", "block"),
        ("http://É.com?/de/", "É.com", "", None, "allow"), ("http://b.com/de/", "b.com", "/de/", "com/de/", "block"), ("no scheme", "", "", None, "allow"), (None, "", "", None, "allow"), ("", "", "", None, "allow"),
        ("x://y://z/fr/", "y:", "//z/fr/", None, "allow"),
    ]
    df = spark.createDataFrame([(i, r[0], None, "h") for i, r in enumerate(rows)], "page_id long, url string, html string, host string")
    got = sorted(tuple(r) for r in urlgraph.filter_urls(df, RULES).select("page_id", "host", "path", "rule", "verdict").collect())
    assert [g[1:] for g in got] == [r[1:] for r in rows]
    assert urlgraph.filter_urls(df.limit(0), RULES).collect() == []


def test_scores_follow_links(spark):
    page = lambda *to: "".join(f'<a class=x href="https://{t}/p">.</a>' for t in to)
    rows = [
        (1, "http://good.org/a", page("friend.net", "Friend.NET")), (2, "http://bad.com/de/x", page("hub.net")), (3, "http://friend.net/x", page("far.net")), (4, "http://farm.net/x", page("bad.com")),
        (5, "http://feeder.net/x", page("farm.net", "feeder.net")), (6, "http://far.net/x", None), (7, "http://lone.net/x", ""), (8, "http://hub.net/x", page("good.org")),
    ]
    df = spark.createDataFrame(rows, "page_id long, url string, html string")
    got = {r.page_id: r for r in urlgraph.filter_urls(df, RULES).collect()}
    assert {i: got[i].verdict for i in got} == {1: "allow", 2: "block", 3: "allow", 4: "block", 5: "block", 6: "allow", 7: "allow", 8: "allow"}
    # the same by plain iteration
    edges = {("good.org", "friend.net"): 1, ("bad.com", "hub.net"): 1, ("friend.net", "far.net"): 1, ("farm.net", "bad.com"): 1, ("feeder.net", "farm.net"): 1, ("hub.net", "good.org"): 1}
    hosts = {h for e in edges for h in e} | {"lone.net"}

    def ranks(seed, edges):
        """Personalised PageRank in which hosts without links give all they have back to the seed."""
        score = {h: float(h == seed) for h in hosts}
        for _ in range(400):
            lost = sum(s for h, s in score.items() if h not in {a for a, _ in edges})
            new = {h: (0.15 + 0.85 * lost) * (h == seed) for h in hosts}
            for a, b in edges:
                new[b] += 0.85 * score[a]
            score = new
        return score

    trust, distrust = ranks("good.org", list(edges)), ranks("bad.com", [(b, a) for a, b in edges])
    for r in got.values():
        assert abs(r.trust - trust[r.host]) < 1e-4 and abs(r.distrust - distrust[r.host]) < 1e-4


def test_unrelated_seeds_and_long_chains_change_no_verdict(spark):
    link = lambda to: f'<a href="http://{to}/p">.</a>'
    rows = [("http://bad.com/de/x", ""), ("http://farm.net/x", link("bad.com")), ("http://feeder.net/x", link("farm.net"))]
    rows += [("http://h0.net/x", link("farm.net"))] + [(f"http://h{i}.net/x", link(f"h{i - 1}.net")) for i in range(1, 26)]
    rows += [(f"http://s{i}.org/x", "") for i in range(10_000)]
    df = spark.createDataFrame([(i, *r) for i, r in enumerate(rows)], "page_id long, url string, html string")
    got = {r.host: r for r in urlgraph.filter_urls(df, RULES).collect()}
    assert {h: r.verdict for h, r in got.items() if not h.endswith(".org")} == {h: "block" for h in ("bad.com", "farm.net", "feeder.net", *(f"h{i}.net" for i in range(26)))}
    # farm.net shares its distrust between the two hosts that link to it
    for i in range(26):
        assert abs(got[f"h{i}.net"].distrust / (got["farm.net"].distrust * (0.85 / 2) * 0.85**i) - 1) < 1e-6
    assert abs(sum(r.distrust for r in got.values()) - 1) < 1e-6
    assert all(r.verdict == "allow" and r.distrust == 0 for h, r in got.items() if h.endswith(".org"))


def test_blocks_of_broken_pages():
    text = lambda page: [(b.place[0], b.text) for b in html_text.blocks_of(page)]
    assert text(None) == text("") == text("<!-- x") == []
    assert text("<p>a<b>b &amp; c<br>d<p>e</div><li>f<li>g") == [("p", "ab & c d"), ("p", "e"), ("li", "f"), ("li", "g")]
    assert text("<script>if(a<b)'</p>'</script><p title='a>b'>x &eacute;&#233; &am</p>tail") == [("p", "x éé &am"), ("", "tail")]
    assert text("<table><tr><td>1<td>2<tr><td>3</table>") == [("td", "1"), ("td", "2"), ("td", "3")]
    assert text("a < b and 1 <2") == [("", "a < b and 1 <2")]


def test_field_on_unseen_layouts():
    field = html_text.default_field()
    pages = html_text.training_pages(150, seed=77)
    right = total = 0
    for page, labels in pages:
        got = field.decode(html_text.blocks_of(page))
        assert len(got) == len(labels)
        right += sum(a == b for a, b in zip(got, labels, strict=True))
        total += len(labels)
    assert right / total > 0.99


def test_pages_labelled_by_hand():
    from .labelled_pages import LABELLED

    field = html_text.default_field()
    for page, want in LABELLED:
        assert html_text.main_text(page, field) == want


def test_deep_pages_take_time_by_their_length():
    import time

    took = []
    for n in (3000, 30_000):
        page = "<article>" + "<div class=x><p>some words here</p></section></b>" * n
        began = time.perf_counter()
        blocks = html_text.blocks_of(page)
        took.append(time.perf_counter() - began)
        assert len(blocks) == n and {b.text for b in blocks} == {"some words here"}
    assert took[1] < 30 * took[0] + 0.5


def test_viterbi_equals_all_paths():
    from itertools import product

    field = html_text.default_field()
    blocks = html_text.blocks_of(html_text.training_pages(1, seed=5)[0][0])[:9]
    scores, moves, start = field.scores(blocks), field.moves, field.start
    total = lambda p: start[p[0]] + sum(scores[i][x] for i, x in enumerate(p)) + sum(moves[a][b] for a, b in zip(p, p[1:], strict=False))
    assert abs(total(field.decode(blocks)) - max(map(total, product((0, 1), repeat=len(blocks))))) < 1e-9


def test_extracted_text(spark):
    page = (
        "<html><head><title>T</title></head><body><header><p>Site</p></header><nav><ul><li><a href=/a>A</a></li></ul></nav><div class='cookie-notice'><p>We use cookies.</p></div>"
        "<article><h1>Head &lt;line&gt;</h1><p>First  paragraph\n here.</p><div class='ad'>Buy now</div><p>Oui.</p></article><section class='comments'><h3>2 comments</h3><p>I like this very much.</p></section>"
        "<aside><p>More to read</p></aside><form><label>Mail</label></form><footer>&copy; us</footer></body></html>"
    )
    rows = [(1, page, "t"), (1, page, "t"), (2, None, "t"), (3, "", "t"), (4, "<article>" + "<p>long words here.</p>" * 3000, "t")]
    df = spark.createDataFrame(rows, "page_id long, html string, text string")
    got = sorted((r.page_id, r.text) for r in html_text.extract_text(df).collect())
    main = "Head <line>\nFirst paragraph here.\nOui."
    assert got == [(1, main), (1, main), (2, ""), (3, ""), (4, "\n".join(["long words here."] * 3000))]
    assert html_text.extract_text(df.limit(0)).collect() == []


def chats(spark, rows):
    df = spark.createDataFrame(rows, "conv_id long, turn long, role string, text string").withColumn("position", F.lit(9))
    return [tuple(r) for r in chat.format_chats(df).orderBy("conv_id", "position").select("conv_id", "position", "turn", "text", "reply_turn", "n_quotes", "n_linked").collect()]


def test_replies_follow_what_they_quote(spark):
    rows = [
        (1, 0, "user", "First question?\n\nAnother paragraph."), (1, 1, "assistant", "An answer."), (1, 2, "user", "More."),
        (1, 3, "user", "On Monday, A wrote:\n> first  QUESTION\nYes to that."), (1, 4, "user", "> > An answer.\n> Yes to that.\nNested."), (1, 5, "user", "> never said\nok"),
        (2, 0, "user", None), (2, 1, "user", "> \n>"), (2, 1, "user", "b"), (None, 5, "user", "x"), (None, None, "user", "y"),
    ]
    assert chats(spark, rows) == [
        (None, 1, None, "y", None, 0, 0), (None, 2, 5, "x", None, 0, 0),
        (1, 1, 0, "First question?\n\nAnother paragraph.", None, 0, 0), (1, 2, 3, "Yes to that.", 0, 1, 1), (1, 3, 4, "Nested.", 3, 2, 2),
        (1, 4, 5, "ok", 4, 1, 0), (1, 5, 1, "An answer.", 0, 0, 0), (1, 6, 2, "More.", 1, 0, 0),
        (2, 1, 0, "", None, 0, 0), (2, 2, 1, "", 0, 0, 0), (2, 3, 1, "b", 1, 0, 0),
    ]


def test_parts_of_messages_are_quoted(spark):
    first = "Hello all,\nthe first line of it\nthe second line of it\nthe third line\n\nA middle paragraph.\n\nA last one,\nin two lines.\n\n--\nA. Signature"
    rows = [
        (1, 0, "user", first), (1, 1, "user", "Hello all,\nsomething else"), (1, 2, "user", "Between."),
        (1, 3, "user", "> the second line of it\n> the third line\nLines."), (1, 4, "user", "> A middle paragraph.\n>\n> A last one, in\n> two lines.\nParagraphs."),
        (1, 5, "user", "\n".join("> " + x for x in first.split("\n")[:-3]) + "\nWithout its signature."), (1, 6, "user", "> Hello all,\n> something else\nThe longest part."),
        (1, 7, "user", "> Hello all,\n> something else\n>\n> never said\nPart of it."), (1, 8, "user", "> never said\n> nor this\nNothing."),
    ]
    got = {r[2]: r[4:] for r in chats(spark, rows)}
    assert got == {0: (None, 0, 0), 1: (0, 0, 0), 2: (1, 0, 0), 3: (0, 1, 1), 4: (0, 1, 1), 5: (0, 1, 1), 6: (1, 1, 1), 7: (1, 1, 1), 8: (7, 1, 0)}


def test_links_against_plain_search(spark):
    """Random threads: each passage's units looked up among the earlier messages one by one."""
    import random
    import re

    rng = random.Random(8)
    say = lambda: " ".join(rng.choice(["red", "green", "blue", "one", "two", "Yes", "no!", "..."]) for _ in range(rng.randint(1, 4)))
    text = lambda: "\n".join(rng.choice(["", say(), say()]) for _ in range(rng.randint(1, 4)))
    rows, clean = [], lambda t: re.sub(r"[\x00-\x2F\x3A-\x60\x7B-\x7F]+", "", t.lower())
    for conv in range(12):
        for turn in range(12):
            t = text()
            for _ in range(rng.randint(0, 2)):
                mark = "> " * rng.randint(1, 2)
                old = rng.choice([r[3] for r in rows if r[0] == conv] or [say()])
                t += "\n" + "\n".join(mark + x for x in old.split("\n")) + "\n" + say()
            rows.append((conv, turn, "user", t))
    parts = lambda t: {u for u in [t, *re.split(r"\n\s*\n", t), *t.split("\n")] if clean(u)}
    own, passages, want = {}, {}, {}
    for conv, turn, _, t in rows:
        level = lambda x: len(re.match(r"[ \t]*(?:>[ \t]*)*", x)[0].replace(" ", "").replace("\t", ""))
        lines, runs = t.split("\n"), []
        for x in lines:
            if runs and runs[-1][0] == level(x):
                runs[-1][1].append(re.sub(r"^[ \t]*(?:>[ \t]*)+", "", x))
            else:
                runs.append((level(x), [re.sub(r"^[ \t]*(?:>[ \t]*)+", "", x)]))
        passages[conv, turn] = [(n, "\n".join(b)) for n, b in runs if n and clean("\n".join(b))]
        quoted = any(level(x) for x in lines)
        own[conv, turn] = re.sub(r"^\s+|\s+$", "", "\n".join(x for x in lines if not level(x))) if quoted else t
    for conv, turn, _, _ in rows:
        found = []
        for n, body in passages[conv, turn]:
            hits = []
            for u in parts(body):
                first = next((k for k in range(12) if clean(u) in {clean(p) for p in parts(own[conv, k])}), turn)
                hits += [(len(clean(u)), first)] if first < turn else []
            found += [(n, -max(hits)[1])] if hits else []
        want[conv, turn] = (-min(found)[1] if found else turn - 1 if turn else None, len(passages[conv, turn]), len(found))
    df = spark.createDataFrame(rows, "conv_id long, turn long, role string, text string")
    got = {(r.conv_id, r.turn): r for r in chat.format_chats(df).collect()}
    for k, w in want.items():
        assert (got[k].reply_turn, got[k].n_quotes, got[k].n_linked) == w and got[k].text == own[k], (k, rows[k[0] * 12 + k[1]])


def test_very_long_messages(spark):
    body = "\n".join(f"line {i} of a long message" for i in range(20_000))
    rows = [(1, 0, "user", body), (1, 1, "user", "\n".join("> " + x for x in body.split("\n")) + "\nAll of it.")]
    assert [r[2:] for r in chats(spark, rows)] == [(0, body, None, 0, 0), (1, "All of it.", 0, 1, 1)]


def test_one_large_conversation(spark):
    n = 3000
    rows = [(1, i, "user", f"message {i}" if i % 500 else f"message {i}\n> message {i // 2 + 1}") for i in range(n)] + [(2, 0, "user", "message 0")]
    got = chats(spark, rows)
    assert len(got) == n + 1 and [r[1] for r in got[:n]] == list(range(1, n + 1))
    # the same order from a tree walk: answers to older messages first, then the conversation's own next message
    answers, nxt = {}, {}
    for i in range(1, n):
        old = i // 2 + 1 if i % 500 == 0 else i - 1
        if old == i - 1 or old >= i:
            nxt[i - 1] = i
        else:
            answers.setdefault(old, []).append(i)
    order, stack = [], [0]
    while stack:
        i = stack.pop()
        order.append(i)
        if i in nxt:
            stack.append(nxt[i])
        stack += reversed(answers.get(i, []))
    assert [r[2] for r in got[:n]] == order


def test_empty_conversations(spark):
    assert chats(spark, [])[:0] == [] and chat.format_chats(spark.createDataFrame([], "conv_id long, turn long, role string, text string")).collect() == []
