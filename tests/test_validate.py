from pyspark.sql import functions as F

from chatloom.operators import validate
from conftest import samples_df


def _repaired(spark, rows):
    out = validate.validate_and_repair(samples_df(spark, rows)).orderBy("ord").collect()
    return {r["ord"]: [(m["role"], m["content"]) for m in r["messages"]] for r in out}


def test_repair_whitespace_and_aliases(spark):
    rows = [(0, [("Human", "  hi 　"), ("gpt", "hello"), (" USER ", "more"), ("bot", "  ok  ")])]
    got = _repaired(spark, rows)
    assert got[0] == [("user", "hi"), ("assistant", "hello"), ("user", "more"), ("assistant", "ok")]
    w = validate.repair_warnings(samples_df(spark, rows)).orderBy("seq").collect()
    msgs = [r["message"] for r in w]
    assert msgs[0] == "Sample 0: Stripped whitespace from message content (role='Human')"
    assert msgs[1] == "Sample 0: Normalized role 'Human' -> 'user'"
    assert "Sample 0: Normalized role ' USER ' -> 'user'" in msgs


def test_drop_rules_first_failing_only(spark):
    rows = [
        (0, [("assistant", "a"), ("user", "q")]),                     # first non-system is assistant
        (1, [("user", "q"), ("user", "q2"), ("assistant", "a")]),     # consecutive users
        (2, [("user", "q"), ("system", "s"), ("user", "q2"), ("assistant", "a")]),  # system between users
        (3, [("user", "q"), ("assistant", "a"), ("user", "q2")]),     # trailing user is fine
        (4, [("user", "q")]),                                          # no assistant
        (5, [("user", "  "), ("assistant", "")]),                      # all blank
        (6, [("tool", "x"), ("user", "q"), ("assistant", "a")]),       # tool removed
    ]
    df = samples_df(spark, rows)
    reasons = {r["ord"]: (r["code"], r["detail"]) for r in validate.drop_reasons(df).collect()}
    assert reasons[0] == ("first_not_user", "Dropped sample: first non-system turn is 'assistant', expected 'user'.")
    assert reasons[1] == ("consecutive_roles", "Dropped sample: consecutive 'user' turns at positions 0,1.")
    assert reasons[2][0] == "consecutive_roles"
    assert 3 not in reasons and 6 not in reasons
    assert reasons[4][0] == "no_assistant"
    assert reasons[5] == ("no_messages", "Dropped sample: no messages remaining after cleanup.")
    got = _repaired(spark, rows)
    assert got[6] == [("user", "q"), ("assistant", "a")]
    w = [r["message"] for r in validate.repair_warnings(df).where("ord = 6").collect()]
    assert w == ["Sample 6: Removed message with unknown role 'tool' (normalized: 'tool')"]


def test_validate_strict(spark):
    rows = [(0, [("human", "q"), ("GPT", "a")]), (1, [("user", " "), ("wizard", "x")]), (2, []),
            (3, [("assistant", "a"), ("user", "q")])]
    errs = validate.validate_strict(samples_df(spark, rows)).orderBy("ord", "seq").collect()
    got = [(r["ord"], r["message"]) for r in errs]
    assert got == [
        (1, "Sample 1: missing 'assistant' turn."),
        (1, "Sample 1, message 0: empty content."),
        (1, "Sample 1, message 1: unknown role 'wizard'."),
        (2, "Sample 2: has no messages."),
    ]


def test_min_answer_filter(spark):
    rows = [(0, [("user", "q"), ("assistant", "x" * 49)]), (1, [("user", "q"), ("assistant", "x" * 25), ("assistant", "y" * 25)]),
            (2, [("user", "q"), ("gpt", "z" * 80)])]
    kept = sorted(r["ord"] for r in validate.min_answer_filter(samples_df(spark, rows)).collect())
    assert kept == [1]  # role must be exactly 'assistant'


def test_repr_of_characters_that_do_not_print(spark):
    from chatloom.functions import py_repr

    texts = ["user", "it's", 'say "x"', """both ' and " """, "a\\b", "new\nline\r\t", "\x00\x1f\x7f", "\x85\xa0\xad", "\u2028\u3000\ufeff", "é日😀", "\U000e0001", ""]
    df = spark.createDataFrame([(t,) for t in texts], "t string")
    assert [r.r for r in df.select(py_repr("t").alias("r")).collect()] == [repr(t) for t in texts]
