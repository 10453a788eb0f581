import pytest
from evidentia.operators import extract
from evidentia.operators.extract import brace_source, edges, facts, python_source, routes, symbols


def names(found):
    return {(a.rsplit(":", 1)[1] if "::" not in a.split(":", 2)[2] else a.split(":", 2)[2], b.split(":", 2)[2], k) for a, b, k, _ in found}


def py(text):
    return python_source.extract("t.py", text)


def test_python_edges():
    s, e, _ = py("z = a\ndef f(q):\n    x = y\n    name = request.args['n']\n    cursor.execute(x, key=q)\n    w = obj.field\n    x = x\n    return x, w\n")
    got = {(a, b, k, line) for a, b, k, line in e}
    assert ("t.py::a", "t.py::z", "assign", 1) in got and ("t.py:f:y", "t.py:f:x", "assign", 3) in got
    assert ("t.py:f:request.args", "t.py:f:name", "subscript", 4) in got and ("t.py:f:q", "t.py:f:cursor.execute", "call_arg", 5) in got
    assert ("t.py:f:obj", "t.py:f:w", "assign", 6) in got and ("t.py:f:field", "t.py:f:w", "assign", 6) in got
    assert ("t.py:f:w", "t.py:f:<return>", "return", 8) in got and not any(a == b for a, b, _, _ in got)
    assert s == [("function", "f", 2, 8)] and py("def (") == ([], [], [])


def test_python_symbols_and_routes():
    s, _, r = py(
        "class A:\n    def m(self):\n        def inner(): pass\n\n@app.route('/u', methods=['GET', 'post'])\n@login\ndef users(): pass\n\n"
        "@router.get('/i')\nasync def items(): pass\n\n@bp.route('/d')\ndef d(): pass\nurlpatterns = [path('x/', views.x)]\n"
    )
    assert s[:3] == [("class", "A", 1, 3), ("method", "m", 2, 3), ("method", "inner", 3, 3)]
    assert [x[:4] for x in r] == [("GET,POST", "/u", "users", "flask"), ("GET", "/i", "items", "fastapi"), ("GET", "/d", "d", "flask"), ("ANY", "x/", "views.x", "django")]


CASES = [
    ("rust", "fn f() { let total = price; total = tax; let zone = order.place; store::save(total); return total; }", [("price", "total", "assign"), ("tax", "total", "assign"), ("order", "zone", "subscript"), ("total", "store::save", "call_arg"), ("total", "<return>", "return")]),
    ("rust", "fn f() { let best = limits::HIGH; let one = rows[k]; let made = build(best); }", [("limits::HIGH", "best", "assign"), ("rows", "one", "subscript"), ("best", "build", "call_arg")]),
    ("go", 'func f(out Sink, in *Form) {\n town := in.Field("town")\n table.Find(town)\n left, right := first, second\n last = left\n return last\n}', [("in.Field", "town", "assign"), ("town", "table.Find", "call_arg"), ("first", "left", "assign"), ("second", "right", "assign"), ("left", "last", "assign"), ("last", "<return>", "return")]),
    ("go", "func f() {\n a, err := load(k)\n b = cfg.Path\n show(cfg.Name)\n}", [("load", "a", "assign"), ("k", "load", "call_arg"), ("cfg.Path", "b", "assign"), ("cfg.Name", "show", "call_arg")]),
    ("java", "class Shop { int f() { String label = title; label = mark; String line = \"#\" + label; printer.print(line); int n = sizes[0]; String w = this.word; return line; } }", [("title", "label", "assign"), ("mark", "label", "assign"), ("label", "line", "assign"), ("line", "printer.print", "call_arg"), ("sizes", "n", "subscript"), ("line", "<return>", "return")]),
    ("php", "<?php function f() { $town = $_POST['town']; $line = $head . $town; send_mail($to, $line); $box->put($line); Log::add($line); return $line . $foot; }", [("$_POST", "$town", "subscript"), ("$head", "$line", "assign"), ("$town", "$line", "assign"), ("$line", "send_mail", "call_arg"), ("$line", "$box->put", "call_arg"), ("$line", "Log::add", "call_arg"), ("$line", "<return>", "return"), ("$foot", "<return>", "return")]),
    ("typescript", "function f(part: string) { const size = width; let city = order.place; const cell = grid[part]; shelf.put(part); size = depth\n return size }", [("width", "size", "assign"), ("order", "city", "subscript"), ("grid", "cell", "subscript"), ("part", "shelf.put", "call_arg"), ("depth", "size", "assign"), ("size", "<return>", "return")]),
]


@pytest.mark.parametrize("language,text,want", CASES)
def test_brace_edges(language, text, want):
    _, e = brace_source.extract("t", text, language)
    got = {(a.split(":", 2)[2], b.split(":", 2)[2], k) for a, b, k, _ in e}
    function = "f"
    for w in want:
        assert w in got, (w, got)
    assert all(a.split(":", 2)[1] == function for a, _, _, _ in e)


def test_brace_symbols():
    get = lambda language, text: brace_source.extract("t", text, language)[0]
    assert get("go", "type S struct {\n}\nfunc (s *S) M() {\n}\nfunc F() {\n}") == [("class", "S", 1, 2), ("method", "M", 3, 4), ("function", "F", 5, 6)]
    assert get("rust", "struct A { b: i32 }\nimpl A { fn m(&self) -> i32 { 1 } }") == [("class", "A", 1, 1), ("function", "m", 2, 2)]
    assert get("java", "class A {\n int m(int a) {\n if (a) { return a; }\n }\n}") == [("class", "A", 1, 5), ("method", "m", 2, 4)]
    assert get("php", "<?php\nfunction f() {\n}") == [("method", "f", 2, 3)]
    assert get("typescript", "class A {\n m(a: B): C {\n }\n}\nconst g = async (x) => {\n}\nfunction h() {}") == [("class", "A", 1, 4), ("method", "m", 2, 3), ("function", "g", 5, 6), ("function", "h", 7, 7)]
    for language in brace_source.LANGUAGES:
        for junk in ("", "{{{", ")]}", '"unclosed', "fn", "a = ", "((", "class {"):
            brace_source.extract("t", junk, language)


LITERALS = [
    ("rust", "fn first<'a>(x: &'a str, y: char) -> &'a str { let z = x; if y == '\\'' || y == '{' { g(z) } z }\nfn last() { let r = r#\"a \" { b\"#; let q = r; }", ["first", "last"], ("x", "z", "assign")),
    ("javascript", "function one(a) { const r = /[{(]\\/\"/g; const b = a / 2; return r.test(b) }\nfunction two(c) { const d = c }", ["one", "two"], ("c", "d", "assign")),
    ("typescript", "function one(a) { const t = `x ${a ? `in {${a}` : \"}\"} {`; }\nfunction two(c) { const d = c }", ["one", "two"], ("c", "d", "assign")),
    ("php", "<?php function one() { $a = <<<EOT\n { ' \" $b\nEOT;\n $c = 'two\nlines {'; }\nfunction two() { $d = $e; }", ["one", "two"], ("$e", "$d", "assign")),
    ("php", "<?php function one() { $a = <<<'X'\nX; }\nfunction two() { $d = $e?->f; }", ["one", "two"], ("$e", "$d", "subscript")),
    ("java", "class A { void one() { String s = \"\"\"\n { \" \n\"\"\"; char c = '}'; }\n void two() { int d = e; } }", ["A", "one", "two"], ("e", "d", "assign")),
    ("go", "func one() {\n s := `\\`\n r := '{'\n}\nfunc two() {\n d := e\n}", ["one", "two"], ("e", "d", "assign")),
]


@pytest.mark.parametrize("language,text,found,edge", LITERALS)
def test_literals_do_not_unbalance_a_file(language, text, found, edge):
    s, e = brace_source.extract("t", text, language)
    assert sorted(x[1] for x in s) == sorted(found)
    assert edge in {(a.split(":", 2)[2], b.split(":", 2)[2], k) for a, b, k, _ in e}


def test_deep_and_hostile_source():
    import time

    began = time.time()
    for language in brace_source.LANGUAGES:
        deep = "function f() { a = " + "g(" * 20_000 + "x" + ")" * 20_000 + "; }"
        brace_source.extract("t", deep, language)
        brace_source.extract("t", "{" * 50_000, language)
        brace_source.extract("t", "([{" * 20_000 + "}" * 20_000, language)
    assert time.time() - began < 60


def test_one_bad_file_is_an_error_row(spark):
    from evidentia.operators.extract import errors

    files = spark.createDataFrame([("deep.py", "python", "x = " + "-" * 3000 + "y"), ("ok.py", "python", "def f(): pass")], "path string, language string, text string")
    found = facts(files)
    assert [r.name for r in symbols(found, "e").collect()] == ["f"]
    assert {r.file_path for r in errors(found, "e").collect()} <= {"deep.py"}


def test_facts(spark):
    files = spark.createDataFrame([("a.py", "python", "def f(x):\n    y = x\n    y = x\n"), ("b.go", "go", "func g() { a := b }"), ("c.md", None, "x"), ("d.py", "python", "@a.get('/')\ndef h(): pass")], "path string, language string, text string")
    found = facts(files)
    assert sorted((r.file_path, r.name) for r in symbols(found, "e").collect()) == [("a.py", "f"), ("b.go", "g"), ("d.py", "h")]
    assert sorted((r.from_symbol, r.line) for r in edges(found, "e").collect()) == [("a.py:f:x", 2), ("a.py:f:x", 3), ("b.go:g:b", 1)]
    assert [r.handler_symbol for r in routes(found, "e").collect()] == ["h"]


def test_symbols_alone_are_those_of_the_whole_file():
    import ast

    sources = [*((language, text) for language, text, *_ in [*CASES, *LITERALS]), ("php", "<?php # function no() {\nfunction yes() {\n} /* { */"), ("go", "func (s *S) M() {\n}\n// func no() {"), ("java", "record P(int x) {\n void m() {\n new Q() {\n int n() { } } } }\n")]
    sources += [("typescript", "class A {\n m(a: B): C {\n }\n}\nconst g = async (x) => {\n}\nrun(function no() {})\nfunction h() {} // `"), ("javascript", "b.c = (x) => {}\nfunction h(")]
    sources += [(language, junk) for language in brace_source.LANGUAGES for junk in ("", "{{{", ")]}", '"unclosed', "fn", "a = ", "((", "class {", "class A {\n\n", "function f() {\n'")]
    for language, text in sources:
        assert brace_source.symbols(text, language) == brace_source.extract("t", text, language)[0], (language, text)
    for text in (ast.__doc__, "def (", "class A:\n def m(self):\n  try:\n   def a(): pass\n  except E:\n   class B: pass\n  else:\n   async def c(): pass\nmatch x:\n case 1:\n  def d(): pass\nfor i in x:\n pass\nelse:\n def e(): pass\n"):
        assert python_source.symbols(text) == py(text)[0]


def test_facts_of_symbols_alone(spark, monkeypatch):
    text = "class A {\n int m(int a) {\n b = a; return b; } }"
    files = spark.createDataFrame([("a.py", "python", "def f(x):\n    y = x\n"), ("b.java", "java", text), ("c.go", "go", "func g() { a := b }"), ("d.md", None, "x"), ("e.rust", "rust", None)], "path string, language string, text string")
    monkeypatch.setitem(extract.EXTRACTORS, "go", lambda file, text: ([("function", "own", 1, 1)], [("a", "b", "assign", 1)], []))
    whole, alone = facts(files), facts(files, symbols_only=True)
    assert {r.tag for r in alone.collect()} == {"symbol"} and alone.schema == whole.schema
    found = sorted(map(tuple, symbols(alone, "e").collect()))
    assert found == sorted(map(tuple, symbols(whole, "e").collect())) and [x[5] for x in found] == ["f", "A", "m", "own"]
