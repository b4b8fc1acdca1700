import random
import re

import pytest
from pyspark.sql import functions as F

from folioflux.config import DEFAULT
from folioflux.operators import chunking as C
from folioflux.operators import structure as S

RNG = random.Random(5)


def prose(n: int, marks: str = ".!?;,", every: int = 12) -> str:
    return " ".join(f"w{RNG.randrange(99)}" + (RNG.choice(marks) if marks and RNG.randrange(every) == 0 else "") for _ in range(n))


TEXTS = [prose(n, marks, every) for n in (0, 1, 149, 150, 300, 301, 400, 401, 900, 2000) for marks, every in ((".!?;,", 12), (".", 40), (".;", 300), ("", 1))]


def run(spark, column, texts):
    df = spark.createDataFrame(list(enumerate(texts)), "i int, t string")
    return [r["v"] for r in df.select("i", column(F.col("t")).alias("v")).orderBy("i").collect()]


def brute_punct(text):
    words, out, at = text.split(), [], 0
    stop = [bool(re.search(r"[.!?;,]$", w)) for w in words]
    for k in range(1, len(words) + 1):
        n = k - at
        if n >= 300 and stop[k - 1] or n == 400 and not any(stop[k - 1 : k + 49]):
            out.append(" ".join(words[at:k]))
            at = k
    return out + ([" ".join(words[at:])] if at < len(words) else [])


def brute_pack(text):
    out, cur, n = [], "", 0
    for part in re.split(r"(?<=[.!?])\s+", text):
        m = len(part.split())
        if m > 400:
            out += ([cur] if cur else []) + brute_punct(part)
            cur, n = "", 0
        elif n + m <= 300:
            cur, n = (cur + " " + part if cur else part), n + m
        else:
            out += [cur] if cur else []
            cur, n = part, m
    return out + ([cur] if cur else [])


def brute_merge(parts):
    out, cur, n = [], "", 0
    for part in parts:
        m = len(part.split())
        if n == 0:
            cur, n = part, m
        elif (n < 150 or m < 150) and n + m <= 400:
            cur, n = cur + "\n\n" + part, n + m
        else:
            out.append(cur)
            cur, n = part, m
    return out + ([cur] if cur else [])


def brute_overlap(a, b):
    parts, n = [], 0
    for s in reversed([x.strip() for x in re.split(r"(?<=[.!?])\s+", a.strip()) if x.strip()]):
        if n + len(s.split()) > 26:
            break
        parts.insert(0, s)
        n += len(s.split())
    if parts:
        return " ".join(parts)
    return " ".join(a.split()[-26:]) if len(a.split()) >= 26 else " ".join(b.split()[:26]) if len(b.split()) >= 26 else ""


def test_packing_against_plain_loops(spark):
    assert run(spark, C.split_at_punctuation, TEXTS) == [brute_punct(t) for t in TEXTS]
    assert run(spark, C.pack_sentences, TEXTS) == [brute_pack(t) for t in TEXTS]
    lines = ["\n".join(RNG.sample(TEXTS, 6)) for _ in range(30)]
    assert run(spark, lambda t: C.merge_small(F.split(t, "\n")), lines) == [brute_merge(t.split("\n")) for t in lines]
    pairs = [f"{a}\n{b}" for a in TEXTS[:20] for b in TEXTS[-6:]]
    got = run(spark, lambda t: C.overlap_text(F.get(F.split(t, "\n"), F.lit(0)), F.get(F.split(t, "\n"), F.lit(1))), pairs)
    assert got == [brute_overlap(*t.split("\n")) for t in pairs]


def test_no_chunk_is_too_long_and_no_word_is_lost(spark):
    for text, chunks in zip(TEXTS, run(spark, lambda t: C.enforce_size(F.array(t)), TEXTS)):
        assert all(len(c.split()) <= 449 for c in chunks)
        assert " ".join(chunks).split() == text.split()
        assert all(len(c.split()) <= 400 for c in chunks)


def brute_sections(lines):
    heads = []
    for k, line in enumerate(lines):
        level = next((h[2] for h in S.HEADINGS if re.match(h[1].replace("\\x1c-\\x1f", ""), line.strip(), re.I)), None)
        if level is not None:
            heads.append((k, level))
    out = []
    for i, (k, level) in enumerate(heads):
        parent = next((j for j in range(i - 1, -1, -1) if heads[j][1] < level), None)
        following = next((j for j in range(i + 1, len(heads)) if heads[j][1] <= level), None)
        out.append((k, level, parent, len(lines) if following is None else heads[following][0]))
    return out


HEADS = ["CHAPTER 1", "PART IV", "SECTION 2: Scope", "1. GENERAL TERMS", "1.2. Scope", "1.2.3. Detail", "a. item", "(4) point"]


def outline():
    return "\n".join(RNG.choice(HEADS) if RNG.random() < 0.3 else prose(RNG.choice([3, 40, 200])) or "x" for _ in range(RNG.randrange(1, 40)))


def test_section_tree_and_chunks(spark):
    texts = [outline() for _ in range(40)]
    df = spark.createDataFrame(list(enumerate(texts)), "doc_id int, text string")
    found = {}
    for r in S.sections(S.lines(df)).orderBy("idx").collect():
        found.setdefault(r["doc"], []).append((r["line"], r["level"], r["parent"], r["content_end"]))
    assert found == {i: b for i, t in enumerate(texts) if (b := brute_sections(t.split("\n")))}
    for text, chunks, tree in zip(texts, run(spark, C.hierarchical_chunks, texts), run(spark, lambda t: C.section_tree(F.split(t, "\n")), texts)):
        lines = text.split("\n")
        want = brute_sections(lines)
        stop = lambda i: next((j for j in range(len(want)) if want[j][0] == want[i][3]), len(want))
        assert [(x["line"], x["level"], x["parent"], x["next_idx"]) for x in tree] == [(k, level, up, stop(i)) for i, (k, level, up, _) in enumerate(want)]
        assert [x["subtree"] for x in tree] == [len(" ".join(lines[k:end]).split()) for k, _, _, end in want]
        if tree:  # every word once, in order
            assert " ".join(chunks).split() == text.split()
        else:
            assert " ".join(chunks) in ("", text)


def test_a_run_takes_children_while_they_fit(spark):
    text = "CHAPTER 1\n" + "w " * 100 + "\n1.1. Scope\n" + "w " * 150 + "\n1.2. More\n" + "w " * 200 + "\n1.3. Last\n" + "w " * 10
    chunks = run(spark, C.hierarchical_chunks, [text])[0]
    assert [c.split("\n")[0] for c in chunks] == ["CHAPTER 1", "1.2. More", "1.3. Last"]
    assert "1.1. Scope" in chunks[0]
    empty = run(spark, lambda t: C.hierarchical_chunks(t, compat=True), ["lost\nCHAPTER 1\nCHAPTER 2\ntext"])[0]
    assert empty == ["CHAPTER 2\ntext"]


@pytest.mark.parametrize(("bare", "name"), [("part initial things", "part"), ("1. Purpose", "numbered_section"), ("1.1 x", None), ("ENCLOSURE 3: x", "enclosure"), ("(12) y", "numbered_item"), ("b. z", "lettered_item")])
def test_headings(spark, bare, name):
    df = spark.createDataFrame([(1, bare)], "doc_id int, text string")
    assert S.headings(S.lines(df)).first()["name"] == name


def test_chunk_documents_edges(spark):
    rows = [(1, None), (2, ""), (3, "  \n "), (4, "two words"), (5, prose(5000, "", 1)), (None, "no id")]
    df = spark.createDataFrame(rows, "doc_id int, text string")
    got = {r["doc"]: r["chunks"] for r in C.chunk_documents(df).collect()}
    assert got[1] == got[2] == got[3] == [] and got[4] == ["two words"] and got[None] == ["no id"]
    assert sum(len(c.split()) for c in got[5]) == 5000
    assert C.chunk_documents(df.limit(0)).count() == 0
    with pytest.raises(ValueError, match="min_words"):
        DEFAULT.with_(min_words=500)


def brute_tables(text):
    lines, found, start, out, last = text.split("\n"), [], None, [], 0
    for k, line in enumerate(lines):
        if "=== TABLE" in line and "START ===" in line:
            start = k
        elif "=== TABLE" in line and "END ===" in line:
            found += [(start, k)] if start is not None else []
            start = None
    for a, b in found:
        before, table = "\n".join(lines[last:a]), "\n".join(lines[a : b + 1])
        both = before + "\n" + table if before.strip() else table
        if len(table.split()) > 450:
            cur, n = [], 0
            out.append(before)
            for line in table.split("\n"):
                if cur and n + len(line.split()) > 300:
                    out.append("\n".join(cur))
                    cur, n = [], 0
                cur.append(line)
                n += len(line.split())
            out.append("\n".join(cur))
        elif len(both.split()) <= 450:
            out.append(both)
        else:
            out += [before, table]
        last = b + 1
    rest = "\n".join(lines[last:])
    out += brute_pack(rest) if len(rest.split()) > 400 else [rest]
    return [c for c in out if c.strip()]


def test_tables(spark):
    line = lambda: RNG.choice(["=== TABLE 1.1 START ===", "=== TABLE 1.1 END ===", prose(RNG.choice([5, 60, 250]))])
    texts = ["\n".join(line() for _ in range(RNG.randrange(1, 14))) for _ in range(60)]
    assert run(spark, C.table_aware_split, texts) == [brute_tables(t) for t in texts]
    assert run(spark, C.table_aware_split, [None, ""]) == [[], []]


def plain_rule(words):
    """The look ahead from the 300th word, whose words begin the next chunk again."""
    out, held, k = [], [], 0
    for k, word in enumerate(words):
        held.append(word)
        if len(held) >= 300:
            ahead = next((j for j in range(k, min(len(words), k + 50)) if words[j][-1] in ".!?;,"), None)
            if ahead is not None:
                out.append(" ".join(held + words[k + 1 : ahead + 1]))
                held = []
            elif len(held) >= 400:
                out.append(" ".join(held))
                held = []
    return out + ([" ".join(held)] if held else [])


def test_long_sentences_in_compat(spark):
    got = run(spark, lambda t: C.split_at_punctuation(t, compat=True), TEXTS)
    assert got == [plain_rule(t.split()) for t in TEXTS]


def test_clean_against_the_rules_one_by_one(spark):
    from folioflux.functions import cleaning, text as T

    texts = ["\n".join(RNG.choice(["", " ", "ab", "a b", "12", " 7 ", "Page 3 of 9", "Scope .... 3", "see  1999", "A. thing 4", "1.2. x 5", "TABLE OF CONTENTS", "SECTION 1: x", "word ,next .then", "http://a.b/c.d , x", "=== x"]) for _ in range(RNG.randrange(0, 30))) for _ in range(300)]
    for text in texts:
        lines = cleaning.remove_toc(text).split("\n")
        x = re.sub(r"[\f\r\v]", "", re.sub(r"\n{4,}", "\n\n\n", re.sub(r"[ \t]+", " ", "\n".join(lines))))
        x = re.sub(r"(?i)\n\s*Page \d+ of \d+\s*\n", "\n", re.sub(r"\n\s*\d{1,4}\s*\n", "\n", x))
        x = "\n".join(y for y in x.split("\n") if len(y.strip()) > 2)
        assert cleaning.clean(text) == cleaning.fix_spacing(x).strip()
    assert run(spark, T.clean, texts) == [cleaning.clean(t) for t in texts]
    assert run(spark, T.fix_spacing, texts) == [cleaning.fix_spacing(t) for t in texts]
    assert run(spark, T.final_cleanup, texts) == [cleaning.final_cleanup(t) for t in texts]
