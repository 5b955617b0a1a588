import random
import re
import unicodedata

from retort.sources.lines import read_lines, rejected_lines, valid_lines

SCHEMA = "line_id bigint, feed string, line_text string, extra string"


def reason_of(line, feed):
    """The rules, read character by character."""
    if line is None:
        return "columns"
    line = line[:-1] if line.endswith("\r") else line
    fields, i = [], 0
    while True:
        if line[i : i + 1] == '"':
            j, text = i + 1, ""
            while True:
                k = line.find('"', j)
                if k < 0:
                    return "quoting"
                text += line[j:k]
                if line[k + 1 : k + 2] != '"':
                    break
                text, j = text + '"', k + 2
            i = k + 1
            if i < len(line) and line[i] != "\t":
                return "quoting"
        else:
            k = line.find("\t", i)
            k = len(line) if k < 0 else k
            text, i = line[i:k], k
        fields.append(text)
        if i >= len(line):
            break
        i += 1
    if len(fields) != {"reverse": 2, "label": 3}.get(feed):
        return "columns"
    if not re.fullmatch(r"(?s).*\S.*-[0-9]+-[0-9]+-[0-9]+", fields[0]) or not fields[1].strip():
        return "value"
    if len(fields) == 3 and "\\chemfig" not in fields[2]:
        return "value"
    for x in fields[1:]:
        depth = 0
        for c in re.sub(r"\\[{}]", "", x):
            depth += (c == "{") - (c == "}")
            if depth < 0:
                return "value"
        if depth:
            return "value"
    if any(c == "�" or (unicodedata.category(c) == "Cc" and c != "\t") for x in fields for c in x):
        return "value"
    return None


EDGES = [
    "", "\r", '"a""b-1-2-3"\tx\t\\chemfig{}', '"' + '""' * 20000 + '"\t\t', "\t" * 30000, "k-1-2-3\ta\nb", "k-1-2-3\tab\r", None,
    '"\t', 'k-1-2-3\t""', "-1-2-3\tx", "a-1-2-3\t{}}{", "a-1-2-3\t\\{ x", 'a-1-2-3\tx"y"', "a-1-2-3\t \t\\chemfig{}", "a-1-2-3\t\t\\chemfig{}",
    '"x"y\t"z"', '"a\t"\tb', "a-1-2-3\tb\t\\chemfig" + "{" * 500 + "}" * 500,
]


def test_reasons_match_brute_force(spark):
    rng = random.Random(5)
    made = ["".join(rng.choice(['"', "\t", "a-1-2-3", "\\chemfig", "{", "}", "\\{", " ", "x", "\r", "é"]) for _ in range(rng.randint(0, 9))) for _ in range(600)]
    rows = [(i, feed, line, "clash") for i, (line, feed) in enumerate((x, f) for x in [*EDGES, *made] for f in ("label", "reverse", None))]
    got = {r.line_id: r.reason for r in read_lines(spark.createDataFrame(rows, SCHEMA)).collect()}
    assert got == {i: reason_of(line, feed) for i, feed, line, _ in rows}


def test_valid_rows_are_typed_and_rejects_keep_their_text(spark):
    rows = [(1, "label", 'p.png-0-12-3\t"a\t""b"""\t\\chemfig{O}\r', "x"), (2, "reverse", "bad", "y"), (2, "reverse", "bad", "y")]
    df = spark.createDataFrame(rows, SCHEMA)
    v = valid_lines(df).collect()
    assert [(r.image_name, r.topic_no, r.column_no, r.line_no_in_column, r.in_text, r.input_chemfig) for r in v] == [
        ("p.png", 0, 12, 3, 'a\t"b"', "\\chemfig{O}")
    ]
    assert [tuple(r) for r in rejected_lines(df).collect()] == [(2, "reverse", "columns", "bad")] * 2
    assert rejected_lines(df.limit(0)).count() == 0
