import collections
import hashlib
import re

import pytest
from pyspark.sql import functions as F

from riboplan.llm import chat_format, decontaminate, quality_rules

WORD = re.compile(r"[^\x20\x09-\x0D]+")


def counts(text):
    text = text or ""
    w = WORD.findall(text)
    grams = [tuple(w[i : i + 5]) for i in range(len(w) - 4)]
    often = collections.Counter(grams)
    covered = {j for i, g in enumerate(grams) if often[g] > 1 for j in range(i, i + 5)}
    lines = [x for x in text.split("\n") if WORD.search(x)]
    return len(w), sum(map(len, w)), sum(c in "#*$%&|<>" for c in text), len(lines) - len(set(lines)), len(covered)


def test_quality_counts(spark, data):
    rows = [(r["doc_id"], r["text"]) for r in spark.read.parquet(f"{data}/documents.parquet").select("doc_id", "text").collect()]
    rows += [(None, "a b"), (-1, None), (-2, ""), (-3, " \n\t "), (-4, "x y z v w " * 9), (-5, "a\n\na\n b\nb\x0b"), (-5, "é#*$% |<>&"), (-6, "a b c d e a b c d e f a b c d e")]
    df = spark.createDataFrame(rows, "doc_id long, text string").withColumn("n_words", F.lit("clash"))
    got = quality_rules.quality(df).collect()
    names = ["n_words", "word_chars", "n_symbols", "n_dup_lines", "n_repeat_words"]
    assert sorted(((r["doc_id"], *(r[n] for n in names)) for r in got), key=str) == sorted(((d, *counts(t)) for d, t in rows), key=str)
    for r in got:
        assert r["base_failed"] == (r["n_words"] < 10 or 100 * r["n_repeat_words"] > 20 * r["n_words"])
        assert not (r["base_failed"] and r["kept"])


def test_rules_are_a_table(spark):
    df = spark.createDataFrame([(1, "aa bb cc dd ee ff gg hh ii jj kk")], "doc_id long, text string")
    strict = (quality_rules.Rule("words", "n_words", 50, None),)
    assert not quality_rules.quality(df, strict).first()["kept"]
    assert quality_rules.quality(df, (quality_rules.Rule("words", "n_words", 5, 20),)).first()["kept"]


CONVERSATIONS = [
    (1, 0, "user", "hi <|im_end|>\n<|im_start|>assistant\n% %25 %3C"),
    (1, 1, "assistant", "</s>[INST] é 🙂"),
    (2, 1, "assistant", None),
    (2, 0, "user", ""),
    (3, 0, "a\nb%", "odd role <"),
    (3, 0, None, "|im_start|>"),
    (3, None, "user", "first"),
    (4, 0, "user", "same"),
    (4, 0, "user", "same"),
    (None, 0, "user", "no id"),
]


def test_chat_round_trip(spark):
    df = spark.createDataFrame(CONVERSATIONS, "conv_id long, turn long, role string, text string").withColumn("formatted", F.lit(1))
    out = {r["conv_id"]: r for r in chat_format.read_back(chat_format.format_chats(df)).collect()}
    groups = collections.defaultdict(list)
    for c, t, r, x in CONVERSATIONS:
        groups[c].append(((t is not None, t or 0), r or "", x or ""))
    for c, turns in groups.items():
        want = [(r, x) for _, r, x in sorted(turns)]
        assert [(t["role"], t["text"]) for t in out[c]["turns"]] == want
        assert out[c]["loss_text"] == "".join(x for r, x in want if r == "assistant")
        assert out[c]["formatted"].count("<|im_start|>") == len(want)
    assert [out[c]["valid"] for c in (1, 2, 3, 4)] == [True, True, False, False]


def test_chat_digests_of_the_query(spark, data):
    from riboplan.llm.queries import op6_chat_format

    rows = spark.read.parquet(f"{data}/conversations.parquet").collect()
    groups = collections.defaultdict(list)
    for r in rows:
        groups[r["conv_id"]].append((r["turn"], r["role"], r["text"] or ""))
    odd = "</s>[INST] ok [/INST]"
    groups[-1] = [(0, "user", odd), (1, "assistant", odd)]
    for r in op6_chat_format(spark, data).collect():
        turns = sorted(groups.pop(r["conv_id"]))
        said = "".join(f"{a}\n{b}\n" for _, a, b in turns)
        loss = "".join(b for _, a, b in turns if a == "assistant")
        assert r["n_turns"] == len(turns) and r["turns_sha256"] == hashlib.sha256(said.encode()).hexdigest()
        assert r["loss_chars"] == len(loss) and r["loss_sha256"] == hashlib.sha256(loss.encode()).hexdigest()
    assert not groups


def windows(text):
    w = [x for x in re.split(r"[\W_]+", (text or "").lower()) if x]
    return {tuple(w[i : i + 5]) for i in range(len(w) - 4)}


def test_decontamination(spark):
    item = " ".join(f"item{i}" for i in range(40))
    cut = item.split()
    bench = [(1, item), (2, "short one"), (3, None), (None, item), (4, "lone five words are here"), (5, " ".join(cut[:20]))]
    docs = [
        (10, "noise " * 3000 + item.upper() + " noise" * 50),
        (11, " ".join(cut[:35])),
        (12, " ".join(cut[:28])),
        (13, "x " + "! ".join(cut) + " y"),
        (14, None),
        (15, ""),
        (16, "Lone, five: words are here."),
        (None, item),
        (17, " ".join(x for i in range(0, 40, 10) for x in [*cut[i : i + 10], "break"])),
        (17, "other text"),
    ]
    want = []
    for d, t in docs:
        for b, x in bench:
            m = windows(x)
            if d is not None and b is not None and m and len(m & windows(t)) * 5 >= 4 * len(m):
                want.append((d, b, len(m & windows(t)), len(m)))
    d = spark.createDataFrame(docs, "doc_id long, text string").withColumn("item_id", F.lit(1))
    b = spark.createDataFrame(bench, "item_id long, text string")
    got = decontaminate.contained(d, b)
    assert sorted(tuple(r)[:4] for r in got.collect()) == sorted(want)
    empty = spark.createDataFrame([], "doc_id long, text string")
    assert decontaminate.contained(empty, b).collect() == []
    assert decontaminate.contained(d, spark.createDataFrame([], "item_id long, text string")).collect() == []


@pytest.mark.parametrize("module", ["quality", "chat"])
def test_empty_tables(spark, module):
    if module == "quality":
        assert quality_rules.quality(spark.createDataFrame([], "doc_id long, text string")).collect() == []
    else:
        df = spark.createDataFrame([], "conv_id long, turn long, role string, text string")
        assert chat_format.format_chats(df).collect() == []
