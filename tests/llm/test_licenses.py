import random
import re

from cases import ODD, frame, row

from sentinela.llm.license_scan import TEMPLATES, THRESHOLD, scan_licenses


def pairs(text):
    w = re.findall("[a-z0-9]+", re.sub("[A-Z]", lambda m: m[0].lower(), text))
    return set(zip(w[:-1], w[1:], strict=True))


def expected(text):
    text = text or ""
    lines, blocks, block = text.split("\n"), [], []
    for line in lines:
        if re.search("[A-Za-z0-9]", line):
            block.append(line)
        else:
            blocks.append("\n".join(block))
            block = []
    found = {}
    for passage in [*lines, *blocks, "\n".join(block), text]:
        own = pairs(passage)
        for name, template in TEMPLATES.items():
            t = pairs(template)
            dice = 2 * len(own & t) / (len(own) + len(t))
            if own and dice >= THRESHOLD:
                found[name] = max(dice, found.get(name, 0))
    best = min(found.items(), key=lambda x: (-x[1], x[0])) if found else (None, 0)
    return best[0], round(best[1], 6), ",".join(sorted(found))


def test_against_every_passage_and_template(spark):
    mit = TEMPLATES["mit-text"]
    wrapped = "\n".join(" * " + " ".join(mit.split()[i : i + 9]) for i in range(0, len(mit.split()), 9))
    rows = ODD + [
        row(100, "Intro.\nReleased under the MIT License.\nThis work is licensed under the GNU General Public License, version 3.\nEnd"),
        row(101, "/*\n" + wrapped + "\n */\nint main() {}"), row(102, "Code above.\n\n" + mit.replace("Software", "Program") + "\n\nCode below " * 50),
        row(103, "RELEASED, under: the (mit) license"), row(104, "the MIT campus and the License of a driver"),
        row(105, "Licensed under CC BY-NC 4.0."), row(106, "licensed"), row(107, "x\n" * 500 + TEMPLATES["isc"])]
    got = scan_licenses(frame(spark, rows)).collect()
    have = sorted(((r.doc_id, r.license, r.score, r.licenses) for r in got), key=str)
    assert have == sorted(((r[0], *expected(r[1])) for r in rows), key=str)
    by_id = {r.doc_id: r for r in got}
    assert by_id[100].licenses == "gpl-2.0,gpl-3.0,mit" and by_id[100].license == "gpl-3.0" and by_id[101].license == "mit-text" and by_id[102].license == "mit-text" and by_id[104].license is None
    assert scan_licenses(frame(spark, [])).count() == 0


def test_notices_within_lines_and_over_blank_lines(spark):
    gpl, apache = TEMPLATES["gpl-header"], TEMPLATES["apache-2.0-header"]
    one, two = gpl[: gpl.index("This program is distributed")], gpl[gpl.index("This program is distributed") :]
    code = "".join(f"\n\nint f{i}(int a{i}, char **b{i}) {{\n  return g{i}(a{i}, b{i});\n}}\n" for i in range(60))
    rows = [
        row(1, f"/*\n * {one}\n *\n * {two}\n */" + code), row(2, "Copyright 2020 Jane Doe. Released under the MIT License."),
        row(3, "This project is great. Released under the MIT License. See the file for more. " * 3 + code.replace("\n", " ")),
        row(4, "Intro " + apache.replace(" Unless", "\n#\n# Unless").replace(" See the", "\n\nSee the") + code.replace("\n", " ")),
        row(5, "first " + TEMPLATES["isc"] + " then " + TEMPLATES["mit"] + " last" + code), row(6, one + code), row(7, "Released under the"), row(8, "MIT License."),
        row(9, "a b " + " ".join(["the MIT License", "under the"] * 3000))]
    got = {r.doc_id: (r.license, r.score, r.licenses) for r in scan_licenses(frame(spark, rows)).collect()}
    assert got[1] == ("gpl-header", 1.0, "gpl-header") and got[4] == ("apache-2.0-header", 1.0, "apache-2.0-header")
    assert got[2] == got[3] == ("mit", 1.0, "mit") and got[5] == ("mit", 1.0, "isc,mit")
    assert got[6] == got[7] == got[8] == (None, 0.0, "")


def test_runs_against_every_run(spark):
    rng = random.Random(5)
    templates = {"one": "a b c d e f g h", "two": "d e f x y", "three": "a b c d e f g h i j k l m n"}
    rows = [row(i, " ".join(rng.choices("abcdefghijklmnxyz", k=6) + list(rng.choice(["abcdefgh", "defxy", "abcdefghijklmn", "abcdegh", "abcefghijkmn"])) + rng.choices("abcxyz", k=9)) + " 0 1 2" * 40)
            for i in range(150)]
    got = {r.doc_id: set(filter(None, r.licenses.split(","))) for r in scan_licenses(frame(spark, rows), templates).collect()}
    for r in rows:
        w, want = r[1].split(), {}
        for name, template in templates.items():
            t = pairs(template)
            for i in range(len(w)):
                for j in range(i + 2, min(len(w), i + 1 + int(len(t) * 1.5)) + 1):
                    own = set(zip(w[i : j - 1], w[i + 1 : j], strict=True))
                    if 2 * len(own & t) >= THRESHOLD * (len(own) + len(t)):
                        want.setdefault(name, []).append((i, j))
        assert got[r[0]] <= set(want)
        longest = max(want, key=lambda n: len(templates[n]), default=None)
        assert longest is None or longest in got[r[0]]
    assert len({frozenset(x) for x in got.values()}) >= 4
