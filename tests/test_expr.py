"""The expression language: parsing, and the compiler against the evaluator."""

import pytest
from pyspark.sql import functions as F

from tessella.plans.expr import ExprError, extend, mutate, parse, predicate, register, select_expr, skip_null
from tessella.plans.expr import compiler as C
from tessella.plans.expr.api import as_text, evaluate_rows, running
from tessella.plans.expr.evaluator import Env, evaluate, show
from tessella.plans.expr.parser import Binary, Call, Lambda, Lit, Name, Ref

ROWS = [("10", "Ann Lee", "", "2.5"), ("-3", "böb", "x,y,,z", "0"), ("7", "  trim me ", "a", "1e3"), ("0", "", "Q", "nan")]
COLUMNS = ["n", "name", "tags", "price"]

#: Values of several types in one list, or of a type that differs by row.
MIXED = [
    "[7, 'seven', null]", "[3, 0.5]", "map([6, 9], v => [v, 'c'])", "sort([14, 'm', 3])", "sort([2.5, true, 'b', null, 1])", "unique([4, '4', 4.0, 4])", "[true, 1, 'true']", "concat([1], ['a', 2.5])",
    "zip([1, 2], ['x', 'y'])", "join([1, 'a', 2.5, null, false], '|')", "map([5, '5', null, 0, ''], v => type(v))", "filter([0, 'a', '', 3, null], v => v)", "contains([1, 'b'], 'b')", "contains([1, 'b'], 1.0)",
    "if(@n > 0, @n + 1, 'none')", "default(@price * 0, 'zero')", "if(@n > 0, 'some', 0) | type()", "replace_nth([1, 2], 0, 'x')", "first([9, 'z']) == 9", "reduce([1, 2.5], 0, (s, v) => s + v)",
    "map([@n, 'k', @name], v => v)", "if(@n > 0, true, 2) == true", "len([1, 'a'])", "max(nth([4, 'a'], 0), 3)", "if(@n > 5, 1.5, 'x') ++ '!'",
]

SAME = [
    "4 + 6 * 2", "(4 + 6) * 2", "9 / 8", "23 % 9", "-23 % 9", "3 ** 2 ** 2", "-8 + 11", "not false", "6 == 6.0", "'k' ++ 12 ++ null", "3 < 9 and 9 >= 4",
    "'pine' lt 'pinf'", "6 == '6'", "null == null", "'oak' != null", "@n ++ '?'", "len(@name)", "len('Öl')", "char_len('Öl')", "len(null)", "len([8, 9, 4])", "upper(@name)",
    "@name | trim() | upper()", "@name.trim().lower().substr(1, 2)", "'tessellation' | substr(_, 3, 4)", "split('x/yy/z', '/')", "split('', ';')", "split('qrs', '')",
    "join(split('17:45:09', ':'), ' ')", "first([14, 3])", "last(['elm', 'ash'])", "first([])", "nth([21, 34, 55], 2)", "nth([21], -1)", "replace_nth([21, 34, 55], 0, 8)",
    "sort([44, 7, 19])", "sort(['fir', 'ash'])", "sort_by(['willow', 'yew', 'alder'], w => len(w))", "unique([6, 4, 6])", "slice([11, 12, 13, 14], 2, 4)", "slice([11, 12, 13], 1)",
    "reduce([7, 8, 10], 100, (s, v) => s - v)", "map([15, 25], v => v - 5)", "filter([31, 8, 77, 2], v => v < 30)", "take_while([9, 8, 3, 9], v => v > 5)",
    "range(3)", "range(7, 10)", "range(9, 2, -3)", "range(6, 5)", "flatten([[12], [13, 14]])", "zip([6, 7, 8], [1, 0])", "partition([40, 50, 60], v => v > 45)",
    "flat_map([3, 9], v => [v, -v])", "grouped([5, 6, 7, 8, 9], 2)", "filter_index([80, 2, 91], v => v > 50)", "reverse([17, 18])", "reverse('stone')", "take([90, 80, 70], 1)", "drop('granite', 4)",
    "concat('row', 7, false)", "concat([41], [42, 43])", "contains('mosaic', 'sai')", "contains([16, 17], 17)", "is_empty('')", "is_empty([0])", "starts_with('mosaic', 'mos')",
    "ends_with('mosaic', 'k')", "replace('tile-tile', 'tile', 'T')", "wordcount('  one two\tthree ')", "truncate('a mosaic floor', 9)", "truncate('slab', 7)", "truncate('terrazzo', 5, '>')",
    "abs(-17)", "abs('-6.25')", "round(7.5)", "round(-7.5)", "min(12, 9, 30)", "max(-4, -9)", "int('615')", "int(8.7)", "float(11)", "string(19)", "ceil(6.1)", "floor(-6.1)",
    "sqrt(144)", "pow(3, 4)", "exp(0)", "ln(1)", "log10(100)", "if(false, 8, 9)", "if('', 8)", "default(null, 'gap')", "default(0, 12)", "default('full', 'gap')",
    "regex_match('lot-77', '[0-9]{2}')", "regex_extract('lot-77', '[a-z]+')", "regex_extract('lot', '[0-9]')", "regex_extract('w:31;h:8', 'h:(.)', 1)", "regex_replace('6x4x2', 'x', ' by ')",
    "md5('tile')", "sha256('tile')", "base64('fuß')", "unbase64('ZnXDnw==')", "type(14)", "type([14])", "type(null)", "is_null(null)", "is_int(14)", "is_float(14)", "is_numeric(0.25)", "is_string('q')",
    "fmt('%() or %(2), not %(1)', 'slate', 'chalk')", "fmt('%(:>7)|%(:-<4)', 'ab', 'c')", "fmt('%(:+) %(:04) %(:.3)', 6, -31, 2.71828)", "fmt('%(@n) %[:x] 5%%', 171)",
    "strftime(strptime('1999-12-31 23:05:06', '%Y-%m-%d %H:%M:%S'), '%H.%M on %d/%m/%Y')",
    "@n as @k; @k ++ '/' ++ @k", "5 as @k; @k - 2 as @k; @k * 7", "[64, 32] as @l | len()", "q(that's \\(it\\))", "@0", "@1 ++ @name", "@price == @n", "@n == 10", "not @tags", "default(@tags, 'bare')",
    "map(split(@tags, ','), t => lower(t))", "if(@n > 5 or @name == 'x', 'much', 'little')", *MIXED,
]


@pytest.fixture(scope="module")
def cells(spark):
    return spark.createDataFrame(ROWS, COLUMNS)


def test_compiler_agrees_with_evaluator(spark, cells):
    numbered = cells.coalesce(1)
    out = numbered.select(*(as_text(numbered, e).alias(f"e{i}") for i, e in enumerate(SAME))).collect()
    for cells_, row in zip(ROWS, out, strict=True):
        for i, e in enumerate(SAME):
            want = show(evaluate(parse(e), Env(COLUMNS, list(cells_))))
            got = "null" if row[i] is None else row[i]
            if want != got:
                assert float(got) == pytest.approx(float(want)), (e, cells_)


def test_most_of_it_stays_in_the_jvm(cells):
    fallen = []
    for e in SAME:
        try:
            C.compile_expr(parse(e), C.Scope({f.name: f.dataType for f in cells.schema.fields}, True, "fail"))
        except C.Untypable:
            fallen.append(e)
    assert not fallen


def test_values_of_several_types_need_no_python(spark, cells):
    out = cells.select(*(as_text(cells, e).alias(f"e{i}") for i, e in enumerate(MIXED)))
    assert "Python" not in out._jdf.queryExecution().executedPlan().toString()
    assert select_expr(cells, "[@n as @k, [@n, 'x'] as @both]").dtypes == [("k", "string"), ("both", "string")]
    semi = spark.sql("select parse_json(j) v from values ('1'), ('\"b\"'), ('2.5'), ('true'), (null) t(j)")
    assert [r.k for r in select_expr(semi, "type(@v) ++ ' ' ++ @v as @k").collect()] == ["int 1", "string b", "float 2.5", "bool true", "null null"]


def test_every_function_is_compiled_and_evaluated():
    assert len(C.COMPILED) >= 81 and C.COMPILED.keys() == C.FUNCTIONS.keys()


def test_tree():
    assert parse("@a + 2 * x") == Binary("+", Ref("a"), Binary("*", Lit(2), Name("x")))
    assert parse("@x | f(_, 1)") == Call("f", (Ref("x"), Lit(1)))
    assert parse("(a, b) => a") == Lambda(("a", "b"), Name("a"))
    assert parse('@"a b" // note') == Ref("a b")
    for bad in ("1 +", "f(", "1 < 2 < 3", "'open", "@a | g(1)", "1 2"):
        with pytest.raises(ExprError):
            parse(bad)


def test_errors_and_lenient_mode(spark, cells):
    with pytest.raises(ExprError):
        select_expr(cells, "@nothing")
    with pytest.raises(ExprError):
        select_expr(cells, "substr('a')")
    with pytest.raises(Exception, match="division by zero"):
        select_expr(cells, "1 / @n").collect()
    rows = select_expr(cells, "1 / @n", on_error="null").collect()
    assert [r[0] for r in rows] == [0.1, pytest.approx(-1 / 3), pytest.approx(1 / 7), None]
    assert select_expr(cells, "sqrt(@n)", on_error="null").collect()[1][0] is None


def test_modes(spark, cells):
    assert [r.n for r in cells.where(predicate("@n > 0 and @price >= 2", cells)).collect()] == ["10", "7"]
    assert extend(cells, total="@n * 2").columns == [*COLUMNS, "total"]
    assert [r.name for r in mutate(cells, "upper(trim(@name)) as @name").collect()] == ["ANN LEE", "BÖB", "TRIM ME", "NULL"]
    with pytest.raises(ExprError):
        mutate(cells, "@n")
    assert skip_null(cells, "regex_extract(@name, 'b')").count() == 1
    assert select_expr(cells, "[@n, @price * 2 as @twice]").columns == ["n", "twice"]
    typed = spark.createDataFrame([(1, 2.0, True)], "a long, b double, c boolean")
    assert select_expr(typed, "if(@c, @a, 0) + @b as @s").first().s == 3.0


def test_globals(spark, cells):
    df = spark.range(1, 101).select(F.col("id"), (F.col("id") % 7).alias("v")).repartition(5)
    sums = {r.id: r.s for r in running(df, "default(@__s, 0) + @v as @__s", ["id"]).collect()}
    assert all(sums[i] == sum(k % 7 for k in range(1, i + 1)) for i in sums)
    last = running(df, "default(@__p, 'none') as @old; @v as @__p; @old", ["id"], name="before").orderBy("id").take(3)
    assert [r.before for r in last] == ["none", "1", "2"]


def test_fallback_matches_direct_evaluation(cells):
    got = [r[0] for r in cells.select(evaluate_rows(cells, "[@n, 'x', null, @name]").alias("x")).collect()]
    assert got == [show(evaluate(parse("[@n, 'x', null, @name]"), Env(COLUMNS, list(r)))) for r in ROWS]


def test_registered_functions(cells):
    register("twice", 1, 1, lambda s: show(s) * 2, lambda c: F.concat(c, c))
    register("shout", 1, 1, lambda s: show(s) + "!")
    assert cells.select(as_text(cells, "twice(@n)").alias("x"), as_text(cells, "shout(@n)").alias("y")).first() == ("1010", "10!")
    with pytest.raises(ExprError):
        register("twice", 1, 1, show)
    for name in ("twice", "shout"):
        C.FUNCTIONS.pop(name)
        C.COMPILED.pop(name, None)
