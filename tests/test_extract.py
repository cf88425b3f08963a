from loquat.sources import extract
from loquat.sources.extract import _accessors, _file_events


def calls(text, callee=None):
    return [e for e in _file_events(text) if e["kind"] == "call" and callee in (None, e["callee"])]


def test_outer_call_first_and_chain_start():
    events = calls('VStack {\n    Text("A")\n        .navigationTitle("B")\n}')
    assert [(e["callee"], e["line"], e["col"]) for e in events] == [("VStack", 1, 1), ("navigationTitle", 2, 5), ("Text", 2, 5)]


def test_scopes():
    text = 'extension ProfileView { var body: some View { Text("a") }\n func makeButton() -> Int { Button("b") }\n class Inner { let t = Text("c") } }\nlet x = Text("d")'
    assert [(e["type_name"], e["property_name"], e["function_name"]) for e in calls(text)] == [("ProfileView", "body", None), ("ProfileView", None, "makeButton"), ("Inner", "t", None), (None, "x", None)]


def test_literals():
    text = 'Text("a \\(name + "x") b")\nText(#"raw "q" \\n"#)\nText("""\n    two\n    lines\n    """)\nText("esc \\" q")'
    got = [(e["arguments"][0]["text"], e["arguments"][0]["interpolated"]) for e in calls(text, "Text")]
    assert got == [("a {…} b", True), ('raw "q" \\n', False), ("two\nlines", False), ('esc \\" q', False)]


def test_comments_and_labels():
    text = '// Text("no")\n/* Text("no") /* nested */ Text("no") */\nText(verbatim: "v") // x\nButton("Del", role: .destructive) { go() }\nUIAlertController(title: "T", message: nil, preferredStyle: .alert)'
    assert [(e["callee"], [(a["label"], a["kind"]) for a in e["arguments"]]) for e in calls(text)] == [("Text", [("verbatim", "string")]), ("Button", [(None, "string"), ("role", "other")]), ("go", []), ("UIAlertController", [("title", "string"), ("message", "nil"), ("preferredStyle", "other")])]


def test_static_constants_and_assignments():
    text = 'enum K { static let a = "A"; let b = "B"\n static var c: String = "C" }\nlabel?.text = "Hi"\nself.title = "T \\(n)"\nx = y\nlet top = "no"'
    events = _file_events(text)
    assert [(e["callee"], e["arguments"][0]["text"]) for e in events if e["kind"] == "static"] == [("a", "A"), ("c", "C")]
    assert [(e["callee"], e["arguments"][0]["text"]) for e in events if e["kind"] == "assignment"] == [("text", "Hi"), ("title", "T {…}")]


def test_member_paths():
    events = _file_events("f(L10n.Home.title)\nL10n.save()\na.b().c\nL10nHelper.save\ng(.red)")
    paths = [e["dotted"] for e in events if e["kind"] == "path"]
    assert paths == ["L10n.Home.title", "c", "L10nHelper.save", ""]
    assert [e["dotted"] for e in events if e["kind"] == "call"] == ["f", "L10n.save", "a.b", "g"]


def test_members_above_an_image():
    text = 'Image("a").resizable().accessibilityLabel("l")\nVStack { Image("b") }.accessibilityElement()'
    assert [e["members"] for e in calls(text, "Image")] == [["accessibilityLabel", "resizable"], []]


def test_columns_are_utf8_bytes():
    assert [(e["line"], e["col"]) for e in calls('let é = Text("x")', "Text")] == [(1, 10)]


def test_broken_source_still_has_a_result():
    for text in ["", "}}}", "Text(", 'Text("a', "struct {", '"', "func (", "{ { {", "a ? b : c : d", "/* x", "((((", "let = = ="]:
        assert isinstance(_file_events(text), list)


def test_generated_accessors():
    text = 'extension i18n {\n enum Home {\n static func `return`() -> String {\n String(localized: "Go", comment: "c") }\n static func n(x: Int) -> String { String(localized: "no") } } }\nextension Other { enum Home { static func z() -> String { String(localized: "no") } } }'
    assert _accessors(text, "i18n") == [{"namespace": "Home", "func_name": "return", "escaped_value": "Go", "escaped_comment": "c"}]


def test_a_text_in_pieces_has_the_same_events(monkeypatch):
    import random

    from loquat.sources import lexer

    rng = random.Random(3)
    words = ["struct A {", "var b: some View {", "static let s = ", '"a"', 'Text("q \\(x("y"))")', '"""\n z\n"""', "/* c\n */", "// c", "}", "{", "(", ")", "if x {", ".m", "é", "let c = ", "func f() {", "\r\n", '"open', "👍", "="]
    for _ in range(300):
        lines = ["".join(rng.choice(words) + rng.choice([" ", "\n"]) for _ in range(rng.randrange(1, 9))) + "\n" for _ in range(rng.randrange(1, 30))]
        want = _file_events("".join(lines))
        monkeypatch.setattr(lexer, "_READ", rng.choice([1, 7, 60]))
        assert list(extract._read_events(lines)) == want
        monkeypatch.undo()


def test_memory_does_not_grow_with_a_file(monkeypatch):
    import itertools
    import tracemalloc

    from loquat.sources import lexer

    monkeypatch.setattr(lexer, "_READ", 1 << 12)

    def peak(lines):
        pieces = itertools.chain(["struct A: View { var body: some View {\n"], ('Text("some text") // c\n' * 500 for _ in range(lines // 500)), ["} }\n"])
        tracemalloc.start()
        n = sum(1 for _ in extract._read_events(pieces))
        top = tracemalloc.get_traced_memory()[1]
        tracemalloc.stop()
        return n, top

    (few, low), (many, high) = peak(4_000), peak(12_000)
    assert (few, many) == (4_000, 12_000) and high < 1.2 * low


def test_files_in_pieces(spark):
    """Many rows of several files, dealt anyhow: events and marked lines are those of the whole files."""
    lines = {f"f{k}": [f'let a{i} = Text("t{i}")' + (" // skip" if i % 7 == k else "") + "\n" for i in range(40 + k)] for k in range(3)}
    whole = spark.createDataFrame([(p, "".join(x)) for p, x in lines.items()], "path string, content string")
    pieces = spark.createDataFrame([(p, i // 3, "".join(x[i : i + 3])) for p, x in lines.items() for i in range(0, len(x), 3)], "path string, piece long, content string").orderBy("content")
    for read in (extract.events, lambda files: extract.ignored_lines(files, "skip")):
        assert sorted(map(repr, read(pieces).collect())) == sorted(map(repr, read(whole).collect()))


def test_what_is_skipped_takes_no_step_of_its_own():
    from loquat.sources import lexer

    text = 'a  // c\n\n  /* d */ ("b")\t+ 1\n'
    steps = [token and token.text for token, _ in lexer._scan(text, 0, len(text), True, True, True)]
    assert steps == ["a", "(", "b", ")", "+", "1", None]
    # A comment's second sign behind the end: nothing is left of it.
    assert [t and t.text for t, _ in lexer._scan("a /* b", 0, 3, True, True, True)] == ["a", None]


def test_cycles_are_not_looked_for_while_files_are_read():
    import gc

    import pyarrow as pa

    seen = []
    run = extract._rows(lambda pieces: iter([{"path": None} for _ in pieces if seen.append(gc.isenabled()) is None]), pa.schema([("path", pa.string())]))
    batch = pa.RecordBatch.from_pydict({"path": ["x"], "content": ["c"], "first": [True]})
    assert [b.num_rows for b in run(iter([batch]))] == [1] and seen == [False] and gc.isenabled()
