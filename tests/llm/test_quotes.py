import random
import re

from siteloom.llm import quotes
from siteloom.session import cut_lineage

SCHEMA = "conv_id long, turn long, role string, text string, position string"


def run(spark, rows):
    docs = spark.createDataFrame([(*r, "x") for r in rows], SCHEMA)
    got = quotes.reply_ordered(docs).collect()
    return sorted(got, key=lambda r: (repr(r.conv_id), r.position or 0, repr(r.turn)))


def test_threads(spark):
    rows = [
        (1, 0, "a", "How do I plant a tree?\n\nAnd how often does it need water?"),
        (1, 1, "b", "Dig a hole first.\nThen put it in."),
        (1, 2, "c", "> Dig a hole first.\n> Then put it in.\nHow deep?"),
        (1, 3, "d", "On Monday a wrote:\n> And how  often does it need WATER\nEvery week."),
        (1, 4, "b", "> How deep?\n>> Dig a hole first.\n>> Then put it in.\nKnee deep."),
        (1, 5, "a", "Thanks."),
        (2, 0, "a", "Alone."),
        (2, 1, "b", "> Dig a hole first.\nNot from here."),
    ]
    got = run(spark, rows)
    one = [r for r in got if r.conv_id == 1]
    # 3 answers the first message: it comes below the branch of 1.
    assert [r.turn for r in one] == [0, 1, 2, 4, 5, 3]
    assert [r.position for r in one] == [1, 2, 3, 4, 5, 6]
    by = {r.turn: r for r in one}
    assert {t: r.reply_to for t, r in by.items()} == {0: None, 1: 0, 2: 1, 3: 0, 4: 2, 5: 4}
    assert {t for t, r in by.items() if r.quoted} == {2, 3, 4}
    assert {t: r.depth for t, r in by.items() if r.depth} == {2: 1, 3: 1, 4: 2}
    assert by[2].text == "How deep?" and by[3].text == "Every week." and by[4].text == "Knee deep."
    assert by[0].text.startswith("How do I")
    two = [r for r in got if r.conv_id == 2]
    assert [(r.turn, r.reply_to, r.quoted) for r in two] == [(0, None, False), (1, 0, False)]


def test_latest_of_several_and_partial_quotes(spark):
    rows = [
        (1, 0, "a", "Yes."), (1, 1, "b", "Why?"), (1, 2, "a", "Yes."), (1, 3, "c", "> Yes.\nSure?"),
        (1, 4, "d", "One line.\nA much longer line stands here.\nEnd."),
        (1, 5, "e", "> A much longer line stands here.\n> Why?\nMixed."),
        (1, 6, "f", "> Mixed.\nFirst.\n> Yes.\nSecond."),
    ]
    by = {r.turn: r for r in run(spark, rows)}
    assert by[3].reply_to == 2 and by[5].reply_to == 4 and by[6].reply_to == 5
    assert by[6].text == "First.\nSecond."


def test_odd_rows(spark, texts):
    rows = [(7, i, "u", t) for i, t in enumerate(texts)]
    rows += [(7, 3, "u", "again"), (7, 3, "u", "again"), (None, 1, "u", "> x"), (8, None, "u", "y"), (9, 0, None, None)]
    got = run(spark, rows)
    assert len(got) == len(rows)
    seven = [r for r in got if r.conv_id == 7]
    assert sorted(r.position for r in seven) == list(range(1, len(seven) + 1))
    assert [r.turn for r in sorted(seven, key=lambda r: r.position)] == sorted(r.turn for r in seven)
    assert all(r.position is None for r in got if r.conv_id in (None, 8))
    assert run(spark, []) == []


def test_long_conversations_are_numbered_in_buckets(spark, monkeypatch):
    monkeypatch.setattr(quotes, "TURNS", 3)
    rows = [(1, i, "u", f"message {i} says this" if i % 5 else f"> message {max(i - 3, 1)} says this\nanswer {i}")
            for i in range(40)]
    got = run(spark, rows)
    parent = {r.turn: r.reply_to for r in got}
    assert parent[15] == 12 and parent[16] == 15 and parent[0] is None
    place = {r.turn: r.position for r in got}
    assert sorted(place.values()) == list(range(1, 41))
    assert all(place[t] > place[p] for t, p in parent.items() if p is not None)

    # Pre-order: what answers a message stands below it without a gap.
    def below(t):
        return 1 + sum(below(c) for c, p in parent.items() if p == t)

    def walk(t):
        at = place[t] + 1
        for c in sorted(c for c, p in parent.items() if p == t):
            assert place[c] == at
            walk(c)
            at += below(c)

    walk(0)


def plain_links(rows):
    """``turn: (reply_to, quoted, position)`` of one conversation, compared turn by turn."""

    def level(line):
        return re.match(r"(?:[ \t]*>)*", line).group().count(">")

    def units(text):
        parts = [text, *re.split(r"\n\s*\n", text), *text.split("\n")]
        return {re.sub(r"[\s!-/:-@\[-`{-~]+", " ", p.lower()).strip() for p in parts} - {""}

    said, parent, quoted = {}, {}, {}
    for turn, text in sorted(rows):
        lines = text.split("\n")
        runs = []
        for at, line in enumerate(lines):
            if level(line):
                if not (runs and runs[-1][1] == at - 1 and runs[-1][0] == level(line)):
                    runs.append([level(line), at, []])
                runs[-1][1] = at
                runs[-1][2].append(re.sub(r"^(?:[ \t]*>)+[ \t]?", "", line))
        linked = []
        for number, (depth, _, own) in enumerate(runs):
            votes = {}
            for unit in units("\n".join(own)):
                earlier = [t for t in said if unit in said[t]]
                if earlier:
                    votes[max(earlier)] = votes.get(max(earlier), 0) + len(unit)
            if votes:
                linked.append((depth, number, max(votes, key=lambda t: (votes[t], t))))
        quoted[turn] = bool(linked)
        parent[turn] = min(linked)[2] if linked else max(said, default=None)
        said[turn] = units("\n".join(x for x in lines if not level(x)))
    place, stack = {}, [t for t in parent if parent[t] is None]
    while stack:
        at = stack.pop()
        place[at] = len(place) + 1
        stack += sorted((t for t in parent if parent[t] == at), reverse=True)
    return {t: (parent[t], quoted[t], place[t]) for t in parent}


def compared(spark, threads):
    got = run(spark, [(c, t, "u", text) for c, rows in threads.items() for t, text in rows])
    for c, rows in threads.items():
        own = {r.turn: (r.reply_to, r.quoted, r.position) for r in got if r.conv_id == c}
        assert own == plain_links(rows)


def test_random_threads_against_plain_code(spark, monkeypatch):
    """Nested, repeated and clashing quotes: few sentences, said again and again."""
    monkeypatch.setattr(quotes, "TURNS", 7)
    rng = random.Random(9)
    threads = {}
    for c in range(12):
        rows = []
        for turn in range(rng.choice([1, 5, 30, 60])):
            lines = [f"Sentence {rng.randrange(40)} of us." for _ in range(rng.choice([1, 1, 2, 3]))]
            for _ in range(rng.choice([0, 1, 1, 2])):
                if rows:
                    source = rng.choice(rows)[1].split("\n")
                    cut = source[: rng.randrange(1, len(source) + 1)]
                    lines[0:0] = ["> " + x for x in cut] + rng.choice([[], [""], ["So."]])
            rows.append((turn * 3, "\n".join(lines)))
        threads[c] = rows
    compared(spark, threads)


def test_deep_and_wide_threads(spark, monkeypatch):
    """Every turn quotes the one two before, or all quote the first: rounds as the logarithm of the
    depth."""
    written = []
    monkeypatch.setattr(quotes, "cut_lineage", lambda df: written.append(1) or cut_lineage(df))
    deep = [(t, (f"> says {t - 2}\n" if t > 1 else "") + f"says {t}") for t in range(200)]
    wide = [(t, ("> says 0\n" if t else "") + f"says {t}") for t in range(200)]
    compared(spark, {1: deep, 2: wide})
    assert len(written) < 2 * 8 + 12
