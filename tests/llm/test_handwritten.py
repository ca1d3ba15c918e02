import base64
import random

import numpy as np

from quern.llm import grammars, handwritten

HAND = '''def mirror_payload(path, mode):
    """Copies what stands under the path, one entry after the other."""
    for entry in sorted(os.listdir(path)):
        if entry.startswith("."):
            continue
        target = resolve(entry, mode=mode)
        try:
            shutil.copy(os.path.join(path, entry), target)
        except OSError as error:
            log.warning("could not copy %s: %s", entry, error)
    return total(path)
'''
GENERATED = "".join(f'  get field{k}() {{ return this.getField({k * 37}, "field_{k}"); }}\n' for k in range(30))
MINIFIED = "!function(e,t){" + "".join(f"function a{k}(b,c){{return b.d?c({k}):void 0}}var e{k}=[{k},4];if(f!=={k}&&!g.h)i('j');" for k in range(30)) + "}"
BLOB = 'module.exports = "' + base64.b64encode(random.Random(1).randbytes(700)).decode() + '"'
TABLE = "T = [\n" + "".join(f"    ({k * 1.37:.4f}, -{k * 2.11:.4f}, {k * 97}),\n" for k in range(40)) + "]\n"


def test_grammar_sizes():
    a = np.array([1, 2, 3, 4] * 32)
    b = np.arange(128) + 10
    g = grammars.infer([a, b, np.zeros(0, int), np.array([5]), np.array([7] * 64)])
    assert g.left[0] + 2 * g.rules[0] < 32 and g.left[1] == 128 and g.rules[1] == 0 and g.left[2] == 0 and g.left[3] == 1 and g.left[4] <= 2
    assert g.reused[0] == 128 and g.reused[1] == 0


def test_evidence():
    e = handwritten.evidence([HAND, GENERATED, MINIFIED, BLOB, TABLE, "", "# Code generated by xgen. DO NOT EDIT.\nx = 1\n"])
    assert e["generated"].tolist() == [False, True, e["generated"][2], False, True, False, True]
    assert e["minified"].tolist() == [False, False, True, False, False, False, False] and e["blob"].tolist() == [False, False, False, True, False, False, False]
    for text in (
        "# Ids are generated by the ticket service\n" + HAND, "# Please do not edit without a review by the page team.\n" + HAND,
        'HEADER = "// Code generated by xgen. DO NOT EDIT."\n' + HAND, "# Copyright 2020 the lumen authors. MIT licence.\n" + HAND,
    ):
        row = handwritten.evidence([text]).iloc[0]
        assert not (row["generated"] or row["minified"] or row["blob"] or row["licensed"])


def test_files(spark):
    rows = [
        ("p/src/a.py::f#1", "v", HAND), ("p/src/a.py::f#1", "w", HAND), ("p/src/g.ts::window#1", "v", GENERATED), ("p/vendor/lib/x.py::h#1", "v", HAND.replace("entry", "item").replace("mirror", "fetch")),
        ("q/own/x.py::h#1", "v", HAND.replace("entry", "item").replace("mirror", "fetch") + "    # added\n"), ("q/lib/tool-1.2.3-00a.py::f#1", "v", "def other():\n    return 1\n"),
        ("q/api/vendor_payments/b.py::f#1", "v", HAND.replace("path", "place")), ("q/api/datagen/c.py::f#1", "v", ""), (None, "v", GENERATED), ("z/n.py::f#1", "v", None), ("p/src/d.py::f#1", "v", HAND),
        ("p/src/d.py::blob#9", "w", BLOB),
    ]
    df = spark.createDataFrame([(*r, "x", 1) for r in rows], "id string, version string, content string, digest string, generated int")
    assert sorted(r["path"] for r in handwritten.not_written_by_hand(df).collect()) == ["p/src/d.py", "p/src/g.ts", "p/vendor/lib/x.py", "q/lib/tool-1.2.3-00a.py", "q/own/x.py"]
    assert handwritten.not_written_by_hand(df.where("false")).count() == 0


def test_blobs_of_any_alphabet():
    digits = random.Random(2).randbytes(800).hex()
    escaped = "".join(f"\\x{digits[k : k + 2]}" for k in range(0, 600, 2))
    wrapped = "DATA = (\n" + "".join(f'    "{digits[k : k + 64]}"\n' for k in range(0, 640, 64)) + ")\n"
    hashes = "KNOWN = [\n" + "".join(f'    "{digits[k : k + 64]}",\n' for k in range(0, 256, 64)) + "]\n"
    plain = 'RULE = "' + "-" * 400 + '"\nZERO = "' + "00" * 300 + '"\n'
    e = handwritten.evidence([f'x = "{digits}"', f'x = "{escaped}"', wrapped, hashes, plain, HAND])
    assert e["blob"].tolist() == [True, True, True, False, False, False]


def test_copies_in_several_projects(spark):
    grown = "".join(HAND.replace("path", a).replace("entry", b).replace("error", c).replace("continue", f"return {a}") for a, b, c in (("depot", "wagon", "flaw"), ("garden", "flower", "weed")))
    own = HAND.replace("mirror", "unique").replace("path", "place").replace("entry", "piece").replace("target", "aim").replace("error", "trouble").replace("shutil", "tools")
    rows = [(f"{p}/lib/copied.py::f#1", "v", HAND) for p in "abc"] + [("a/lib/own.py::f#1", "v", own), ("b/lib/own.py::f#1", "v", own), ("b/lib/own.py::g#30", "v", grown.replace("depot", "harbor").replace("garden", "meadow").replace("copy", "move")), ("d/lib/own.py::f#1", "v", HAND), ("d/lib/own.py::g#30", "v", grown)]
    df = spark.createDataFrame(rows, "id string, version string, content string")
    assert sorted(r["path"] for r in handwritten.not_written_by_hand(df).collect()) == ["a/lib/copied.py", "b/lib/copied.py", "c/lib/copied.py"]


def test_banner_after_a_long_header():
    said = "permission granted|copies kept whole|no warranty of any kind|names stay|notice goes along|claims fall|use is free|sale allowed|merge it|authors hold rights|damages none|as is|fit for nothing|ends here|thanks"
    header = "".join(f"# {line}\n" for line in said.split("|"))
    e = handwritten.evidence([header + "# Code generated by xgen. DO NOT EDIT.\n" + HAND, header + HAND, "/*\n" + header.replace("#", "") + "Code generated by xgen. DO NOT EDIT.\n*/\n" + HAND])
    assert e["generated"].tolist() == [True, False, True]


def test_reuse_at_any_distance_and_what_people_write():
    enum = "class Shade(Enum):\n" + "".join(f"    {n} = {k}\n" for k, n in enumerate("RED BLUE GREEN GREY PINK TEAL LIME NAVY GOLD PLUM ROSE SAND RUST MINT SNOW".split()))
    checks = "def test_slug():\n" + "".join(f'    assert slug("{a} {b}") == "{a}-{b}"\n' for a, b in zip("abcdefghijklmn", "opqrstuvwxyzab", strict=True))
    unit = "".join(f"  step{k}(a{'+' * (k % 5)}b, {'[' * (k % 7)}c{']' * (k % 7)}) {{ {' '.join(['run', 'go;', 'if', '(x)', 'y()'][k % 5 :])} }}\n" for k in range(40))
    far = unit * 8  # what is repeated is longer than any segment
    e = handwritten.evidence([enum, checks, far, HAND])
    assert e["generated"].tolist() == [False, False, True, False]


def test_shared_rules_do_not_depend_on_what_stands_around():
    r = np.random.default_rng(1)
    text, before, after = (r.integers(0, 500, n) for n in (400, 300, 200))
    a, b, c = grammars.shared_rules([text, np.r_[before, text, after], before])
    assert len(set(a) & set(b)) >= 0.8 * len(a) and len(set(b)) >= 900 / 30 and not set(a) & set(c)
    assert grammars.shared_rules([]) == [] and len(grammars.shared_rules([np.zeros(0, int), np.ones(50, int)])[1]) == 0


def test_an_undeclared_copy_in_two_projects(spark):
    other = HAND.replace("mirror", "unique").replace("path", "place").replace("entry", "piece").replace("target", "aim").replace("error", "trouble").replace("shutil", "tools").replace("mode", "way").replace("total", "sum_of")
    rows = [("a/lib/x.py::f#1", "v", HAND), ("b/own/y.py::f#1", "v", HAND + "    # seen\n"), ("c/own/z.py::f#1", "v", other), ("d/own/w.py::f#1", "v", other), ("d/own/w.py::g#30", "v", GENERATED.replace("get", "put")[:300] + HAND.replace("sorted", "list").replace("startswith", "endswith").replace("log", "note").replace("join", "glue").replace("copy", "move").replace("resolve", "settle").replace("listdir", "scan").replace("path", "spot"))]
    df = spark.createDataFrame(rows, "id string, version string, content string")
    assert sorted(r["path"] for r in handwritten.not_written_by_hand(df).collect()) == ["a/lib/x.py", "b/own/y.py"]


def test_twins_among_many_partners(spark):
    r = random.Random(3)
    rules = [r.randrange(10**12) for _ in range(60)]
    few, part, all_of_it = rules[:2], rules[:5], rules[:20]
    held = {
        # x and y are the twins; other files of their projects, before and behind them, hold some of the same rules
        "a/x.py": all_of_it, "b/y.py": all_of_it[1:] + rules[20:21], "a/a.py": part + rules[21:30], "b/z.py": part + rules[30:40],
        # eight rules in ten are shared, of which four with a third project
        "c/v.py": rules[40:50], "d/w.py": rules[40:48] + rules[50:52], "e/u.py": rules[40:44] + rules[52:60], "f/one.py": few[:1], "g/one.py": few[:1],
        # equal files of one project, and equal files of two
        "h/p.py": [1, 2, 3], "h/q.py": [1, 2, 3], "i/p.py": [4, 5], "i/q.py": [4, 5], "j/p.py": [4, 5],
    }
    rows = [(path, path.split("/")[0], rule) for path, rs in held.items() for rule in rs]
    got = sorted(x["path"] for x in handwritten._several(spark.createDataFrame(rows, "path string, project string, rule bigint")).collect())
    assert got == ["a/x.py", "b/y.py", "c/v.py", "d/w.py", "i/p.py", "i/q.py", "j/p.py"]
    for seed in range(3):
        r = random.Random(seed)
        bases = [[r.randrange(10**9) for _ in range(r.randrange(2, 15))] for _ in range(12)]
        sets = {f"{r.choice('abcde')}/{k}": {x if r.random() < 0.9 else r.randrange(10**9) for x in r.choice(bases)} for k in range(80)}
        df = spark.createDataFrame([(p, p[0], x) for p, s in sets.items() for x in s], "path string, project string, rule bigint")
        projects = {x: {p[0] for p, s in sets.items() if x in s} for s in sets.values() for x in s}
        want = {p for p, s in sets.items() if (many := sum(len(projects[x]) >= 3 for x in s)) >= 2 and many >= 0.5 * len(s)}
        want |= {p for p, s in sets.items() for q, t in sets.items() if p[0] != q[0] and len(s & t) >= 2 and len(s & t) >= 0.8 * max(len(s), len(t))}
        assert {x["path"] for x in handwritten._several(df).collect()} == want


def test_twins_between_files_that_share_a_function(spark):
    def file(seed, n):
        r = random.Random(seed)
        words = "if else for while return in not and or with as try raise = + - * / % < > ( ) [ ] { } . , : lamp road tree".split()
        return "".join(f"    {' '.join(r.choice(words) for _ in range(12))} name{r.randrange(10**6)}\n" for _ in range(n))

    shared, own = file(1, 8), file(2, 12)
    texts = {"a/b.py": shared + file(3, 12), "a/m.py": shared + own, "b/c.py": shared + own, "b/n.py": shared + file(4, 12)}
    df = spark.createDataFrame([(f"{p}::f#1", "v", t) for p, t in texts.items()], "id string, version string, content string")
    assert sorted(x["path"] for x in handwritten.not_written_by_hand(df).collect()) == ["a/m.py", "b/c.py"]  # not a/b.py and b/n.py, the first and the last that hold the shared part
