"""Quotation links against a plain linker, over generated trees of quotations."""

from __future__ import annotations

import random
import re

from scanfuse.llm import chat

norm = lambda s: re.sub(r"[\s ]+", " ", s.lower()).strip()


def plain(rows):
    """(parent_conv, parent_turn, quotes, links) of each message; (conv_id, turn) is unique."""
    split = {}
    for c, t, text in rows:
        lines = []
        for x in text.split("\n"):
            mark = re.match(r"^([ \t]*>)+[ \t]?", x)
            lines.append((mark[0].count(">") if mark else 0, x[len(mark[0]) :] if mark else x))
        body = re.sub(r"\n{3,}", "\n\n", "\n".join(x for level, x in lines if not level)).strip(" ") if any(level for level, _ in lines) else text.strip(" ")
        runs = []
        for level, x in lines:
            if runs and runs[-1][0] == level:
                runs[-1][1].append(x)
            else:
                runs.append((level, [x]))
        split[c, t] = body, [(level, "\n".join(xs)) for level, xs in runs if level and norm("\n".join(xs))]
    own = {}
    for at, (body, _) in split.items():
        for s in {norm(x) for x in [*re.split(r"\n[ \t]*\n", body), *body.split("\n"), body]} - {""}:
            own.setdefault(s, []).append(at)

    def home(s, c, t):
        here = [x for x in own.get(s, []) if x[0] == c]
        if here:
            return min(here) if min(here)[1] < t else None
        first = min(own.get(s, []), default=None)
        return first if first and first[0] < c else None

    out = {}
    turns = sorted(split)
    for k, (c, t) in enumerate(turns):
        links = []
        for pos, (level, text) in enumerate(split[c, t][1]):
            for keys in ([text], re.split(r"\n[ \t]*\n", text), text.split("\n")):
                keys = list(dict.fromkeys(filter(None, map(norm, keys))))
                homes = [(h, n) for n, s in enumerate(keys) if (h := home(s, c, t))]
                if homes:
                    counts = {}
                    for h, n in homes:
                        counts.setdefault(h, []).append(n)
                    links.append((level, pos, min(counts, key=lambda h: (-len(counts[h]), min(counts[h]), h))))
                    break
        before = turns[k - 1] if k and turns[k - 1][0] == c else (None, None)
        out[c, t] = (*(min(links)[2] if links else before), len(split[c, t][1]), len(links))
    return out


def test_links_equal_the_plain_linker(spark):
    rng = random.Random(7)
    sentence = lambda: " ".join("".join(rng.choices("abcdefgh", k=4)) for _ in range(rng.randint(2, 6)))
    rows, common = [], sentence()
    for c in range(25):
        for t in range(rng.randint(1, 8)):
            parts = []
            for _ in range(rng.randint(0, 3)):
                if rows:
                    _, _, text = rng.choice(rows[-12:] if rng.random() < 0.8 else rows)
                    lines = text.split("\n")
                    a = rng.randrange(len(lines))
                    piece = lines[a : a + rng.randint(1, 4)]
                    parts += [("> " if rng.random() < 0.7 else ">") + (x.upper() if rng.random() < 0.2 else x.replace(" ", "  ") if rng.random() < 0.2 else x) for x in piece]
                parts += [sentence(), ""] if rng.random() < 0.7 else [sentence(), sentence()]
            parts += [common] if rng.random() < 0.3 else [sentence()]
            rows.append((c, t, "\n".join(parts)))
    df = spark.createDataFrame([(c, t, "user", x) for c, t, x in rows], "conv_id long, turn long, role string, text string").repartition(5)
    got = {(r["conv_id"], r["turn"]): (r["parent_conv"], r["parent_turn"], r["quotes"], r["links"]) for r in chat.link_quotations(df).collect()}
    want = plain(rows)
    assert got == want and sum(v[3] for v in want.values()) > 60


def test_many_quoted_lines_and_lines_like_headers(spark):
    deep = "\n".join((">" * (1 + k % 2)) + f" line {k}" for k in range(8_000))
    rows = [(1, 0, "u", "line 5\nOn the whole he wrote:\nnothing quoted"), (1, 1, "u", deep + "\nend"), (1, 2, "u", "On Monday, X wrote:\n\n> end\nOn and on she wrote:\nyes")]
    got = {r["turn"]: r for r in chat.link_quotations(spark.createDataFrame(rows, "conv_id long, turn long, role string, text string")).collect()}
    assert got[0]["body"] == rows[0][3] and got[1]["body"] == "end" and got[1]["quotes"] == 8_000 and got[1]["links"] == 1
    assert got[2]["body"].split() == "On and on she wrote: yes".split() and got[2]["parent_turn"] == 1


def test_rows_that_repeat_a_turn_have_their_own_parents(spark):
    rows = [(1, 0, "u", "the first word"), (1, 1, "a", "an answer"), (1, 2, "u", "> the first word\nyes"), (1, 2, "u", "other row"), (1, 2, "u", "other row"), (None, 3, "u", "> the first word\nno id"), (2, None, "u", "> the first word\nno turn")]
    got = chat.link_quotations(spark.createDataFrame(rows, "conv_id long, turn long, role string, text string")).collect()
    assert sorted((r["body"], r["linked"], r["parent_turn"], r["quotes"]) for r in got if r["conv_id"] == 1) == [("an answer", False, 0, 0), ("other row", False, 1, 1), ("other row", False, 1, 1), ("the first word", False, None, 0), ("yes", True, 0, 1)]
    assert {(r["body"], r["linked"], r["parent_conv"]) for r in got if r["conv_id"] != 1} == {("no id", False, None), ("no turn", False, None)}
    assert sorted(r["position"] for r in got if r["thread"] == 1) == list(range(5))


def test_turns_before_over_the_parts_of_a_long_conversation(spark):
    """One conversation over many ranges, with gaps, repeats and null turns."""
    turns = [None, None, *(3 * k for k in range(4_000)), *(3 * k for k in range(0, 4_000, 7))]
    rows = [(5, t, "u", f"says {t}") for t in turns] + [(6, t, "u", "other") for t in range(50)]
    before = spark.conf.get("spark.sql.shuffle.partitions")
    spark.conf.set("spark.sql.shuffle.partitions", "23")
    spark.conf.set("spark.sql.adaptive.coalescePartitions.enabled", "false")
    try:
        got = chat.link_quotations(spark.createDataFrame(rows, "conv_id long, turn long, role string, text string")).collect()
    finally:
        spark.conf.set("spark.sql.shuffle.partitions", before)
        spark.conf.unset("spark.sql.adaptive.coalescePartitions.enabled")
    assert len(got) == len(rows)
    for r in got:
        step = 3 if r["conv_id"] == 5 else 1
        assert r["parent_turn"] == (r["turn"] - step if r["turn"] else None)
    assert sorted(r["position"] for r in got if r["conv_id"] == 5) == list(range(len(turns)))
