"""A program that breaks most rules, its findings worked out by hand, and short cases for each rule."""

import pytest

from codequarry.operators.settings import Settings
from codequarry.plans.scan import scan

GOLDEN = r"""//! Fetches mail and files it.

use std::fs;

struct Mailbox { seen: u32 }

impl Mailbox {
    pub fn size(&self) -> u32 { self.seen }

    unsafe fn raw(&self, at: usize) -> u8 {
        // read without a check
        unsafe { *BUFFER.get_unchecked(at) }
    }
}

const SPARE: u8 = 0;
const RETRIES: u8 = 3;

///
fn fetch(name: &str, archive: &Archive) -> Result<(), Error> {
    //
    let tries = RETRIES; let mut left = tries;
    while left > 0 { left -= 1; }
    let Some(header) = archive.next() else { panic!("empty") };
    let draft = header.draft.trim().parse::<u8>().expect("a number");
    let kind = Regex::new(r##"^((((x|y)*z)))+"$"##);
    let wide = Regex::new(&name.to_lowercase());
    if kind.is_match("Re: (a|b)") && valid(name) { dbg!(wide); }
    target.join(header);
    root.push(clean(clean(clean(clean(clean(clean(clean("../up"))))))));
    let volume = level
        .min(loud)
        .max(quiet);
    self::store::put(volume);
    Command::new("pwsh").args(["-NoLogo"]).arg("-Command").arg(name.to_string());
    let auth_token = 'x'; let mail_secret = "swordfish";
    let address = "imap://ann:pw1@mail.local/inbox";
    fs::read(address).or_else(|_| Err(Error::Gone))?;
    /* todo!() /* nested */ unimplemented!() */ todo!()
}

#[tokio::test]
fn counts() {
    // nothing of the crate is asked
    assert_ne!(1, 2);
}

#[test]
#[ignore]
fn fetches() {
    crate::fetch("x", &ARCHIVE).unwrap();
}
"""

# worked out by hand, in the order of the lines
EXPECTED = """
FE021 10:5
FE020 12:9
FE064 16:7
FE061 19:1
FE062 21:5
FE004 24:46
FE076 25:51
FE080 26:27
FE082 27:27
FE083 28:22; FE003 28:52
FE122 29:12
FE120 30:9
FE060 32:9
FE079 34:5
FE100 35:5; FE101 35:60
FE063 36:9; FE042 36:31
FE044 37:19
FE077 38:23
FE075 42:1
FE078 48:1; FE079 51:5
"""


def find(spark, *contents, settings=Settings(), path="src/f{}.rs"):
    files = spark.createDataFrame([(path.format(n), c) for n, c in enumerate(contents)], "path string, content string")
    rows = scan(files, settings).collect()
    out = [[] for _ in contents]
    for r in rows:
        for n in range(len(contents)):
            if r["file"] == path.format(n):
                out[n].append(f"{r['rule_id']} {r['line']}:{r['column']}")
    return [sorted(x) for x in out]


def test_golden_file(spark):
    expected = sorted(x.strip() for line in EXPECTED.split("\n") for x in line.split(";") if x.strip())
    (found,) = find(spark, GOLDEN)
    assert found == expected


def test_toggles(spark):
    off = Settings(rulesets={c: False for c in ("debug", "secrets", "lint", "regex", "shell", "path")}, rules={"FE004": True})
    assert [x.split()[0] for x in find(spark, GOLDEN, settings=off)[0]] == ["FE004", "FE020", "FE021"]


CASES = {
    "macros": ('let _todo = 1;\n// todo!()\ncore::panic!("x");\nmytodo!();\ntodo != 1;\né todo!();', ["FE001 5:1", "FE001 6:4", "FE004 3:7"]),
    "unsafe": ("unsafe fn\nunsafe impl X {}\n/* unsafe */\nunsafe fnx()", ["FE020 2:1", "FE020 4:1", "FE021 1:1"]),
    "clamp over lines": ("let _ = a\n  .max(1)\n  .min(2);\nb.min(c);", ["FE060 2:3"]),
    "clamp far away": ("a.max(" + "x" * 300 + ").min(2);", []),
    "doc paragraphs": ("/// a\n///\n/// b\nfn x() {}\n///\nfn y() {}", ["FE061 5:1"]),
    "empty comments": ("//\n/* */\n// x\n//!\n;", ["FE061 4:1", "FE062 1:1", "FE062 2:1"]),
    "last line keeps its newline": ("x\n//\n", []),
    "shadowing": ("fn f() {\n    let a = 1;\n    let a = a + 1;\n    use_it(a);\n}\n", []),
    "used before shadow only": ("fn f() {\n    let a = 1;\n    go(a);\n    let a = 2;\n}\n", ["FE063 4:9"]),
    "inner block shadow": ("fn f() {\n    let a = 1;\n    {\n        let a = 2;\n        go(a);\n    }\n}\n", ["FE063 2:9"]),
    "patterns": ("fn f() {\n    let Pair { left, right: other } = p;\n    let (Some(x), _y) = q;\n    go(left, x);\n}\n", ["FE063 2:29"]),
    "strings are no uses": ('fn f() {\n    let a = 1;\n    go("{a}", r#"a"#); // a\n    /* a */\n}\n', ["FE063 2:9"]),
    "const": ("const A: u8 = 1;\nconst B: u8 = A;\nconst fn c() {}\n", ["FE064 2:7"]),
    "const used before": ("fn f() { A }\nconst A: u8 = 1;\n", ["FE064 2:7"]),
    "unwrap": ('fn f() {\n    // x.unwrap()\n    "x.unwrap()";\n    a\n        .b()\n        .unwrap();\n    c.unwrap();\n}\n#[test]\nfn t() {\n    crate::x().unwrap();\n    assert!(true);\n}\n', ["FE076 6:10", "FE076 7:5", "FE079 11:5"]),
    "unclosed unwrap": ("fn f() { a.unwrap(; }", ["FE076 1:10"]),
    "async tests are not recognised": ("#[test]\nasync fn t() { x.unwrap(); }\n", ["FE076 2:16"]),
    "attributes between": ("#[test]\n#[should_panic]\n// note\nfn t() { x.unwrap(); crate::y(); }\n", ["FE078 1:1", "FE079 4:22"]),
    "erased errors": ("fn f() { a.or_else(| _ | 1); b.or_else( |_| 2); b.map_err(|_e| 2) }", ["FE077 1:30"]),
    "bound results": ("fn f() {\n    let _ = crate::a();\n    crate::b();\n    go(crate::c());\n    super::d()?;\n    crate::e().f();\n    // n\n    crate::g();\n}\n", ["FE079 3:5", "FE079 6:5"]),
    "assert on comparison": ("#[test]\nfn t() {\n    assert!(a != b);\n}\n", ["FE065 1:1"]),
    "binary under test": ('#[test]\nfn t() {\n    assert!(env!("CARGO_BIN_EXE_product").len() > 0);\n}\n', []),
    "regexes": ('fn f() {\n    let _ = Regex::new(r"^[a+*]+$");\n    let _ = Regex::new(concat!("a", "b"));\n    let _ = Regex::new(concat!("a", c));\n    let _ = Regex::new(\n        "(x*)*"\n    );\n}\n', ["FE080 5:24", "FE082 4:24"]),
    "search context": ('fn find_all() {\n    let _ = Regex::new("[a-z]").is_match(x);\n}\n', []),
    "nearby pattern": ('fn check() {\n    let re = Regex::new("[a-z]+");\n    re.is_match(x);\n}\n', ["FE083 2:25"]),
    "anchored": ('fn check() {\n    let re = Regex::new("^[a-z]+$");\n    re.is_match(x);\n}\n', []),
    "static command": ('fn f() {\n    Command::new("sh").arg("-c").arg("ls");\n    Command::new("sh").args(["-c", x.to_string()]);\n}\n', ["FE100 2:5", "FE100 3:5"]),
    "builder over lines": ('fn f() {\n    Command::new("bash")\n        .arg("-c")\n        .arg(a + " + " + b)\n        .arg(c.to_string());\n}\n', ["FE100 2:5", "FE101 4:10"]),
    "paths": ('fn f() {\n    a.push("..");\n    PathBuf::from("../x");\n    a.join(x.y(".."), z);\n    a.join(safe);\n}\n', ["FE120 2:6", "FE120 3:5", "FE120 4:6"]),
    "safe entries": ("fn extract() {\n    let entry = file.enclosed_name().ok();\n    d.join(entry);\n    d.join(entry.mangled_name());\n}\n", []),
    "canonical entries": ("fn extract(entry: E) {\n    let out = d.join(entry);\n    let real = out.canonicalize();\n    ok(real.starts_with(d));\n}\n", []),
    "fields break chains": ("fn f() { self.records.push(user); }", ["FE121 1:23"]),
    "arguments of calls are not scanned again": ("fn f() { a.go(b.join(user)); h(c.join(user)); }", ["FE121 1:34"]),
    "secrets": ('let x = "nothing";\nlet db_password: &str = "p";\nlet secret = "";\nlet x = "xoxb-1234567890-abc";\nlet _u = "https://host/path";\n', ["FE040 2:5", "FE043 4:9", "FE063 1:5", "FE063 2:5", "FE063 3:5", "FE063 4:5"]),
    "nested comments": ("fn f() {\n    /* a /* /* b */ */\n    let x = 1;\n    */ let y = 2;\n    go(y);\n    let z = 3; /*/ */\n}\nfn g() { a(); /* open /* closed */ h().unwrap(); }\n", ["FE063 6:9"]),
    "a name used in a nested comment only": ("fn f() {\n    let a = 1; /* /* */ a */\n    go(b);\n}\n", ["FE063 2:9"]),
    "quantifiers eight deep": ('fn f() {\n    let _ = Regex::new("((((((((a+))))))))+");\n    let _ = Regex::new("((((((((a))))))))+");\n    let _ = Regex::new(r"(((((((([+*]\\+))))))))+");\n    let _ = Regex::new(")(a*)(b{2})*");\n}\n', ["FE080 2:24", "FE080 5:24"]),
    "arguments eight deep": ('fn f() {\n    let _ = Regex::new(a(b(c(d(e(f(g(h(")("))))))))));\n    x.join(a(b(c(d(e(f(g(h("..")))))))));\n    x.join(a(y.join("..")), "."); z.push("..");\n    x.join(open(y.join(".."));\n}\n', ["FE082 2:24", "FE120 3:6", "FE120 4:6", "FE120 4:36", "FE120 5:18"]),
    "many hashes": ('fn f() {\n    let _ = Regex::new(r#####"(a+)+"####"#####);\n    let a = r####"todo "### let b = 1; "####; go(a);\n}\n', ["FE080 2:24"]),
    "names that come back": ("fn f() {\n    let a = 1;\n    {\n        let a = 2;\n        go(a);\n    }\n    go(a);\n    let a = {\n        let a = a + 1;\n        a\n    };\n    let b = {\n        let b = 3;\n        0\n    };\n    go(b);\n}\nfn g() {\n    let a = a;\n}\n", ["FE063 13:13"]),
    "crlf": ("//\r\ntodo!();\r\n", ["FE001 2:1"]),
    "empty": ("", []),
}


@pytest.fixture(scope="module")
def found(spark):
    return dict(zip(CASES, find(spark, *[c for c, _ in CASES.values()], settings=Settings(maximum=True))))


@pytest.mark.parametrize("name", list(CASES))
def test_case(found, name):
    assert found[name] == sorted(CASES[name][1])


def test_suppressions(spark):
    contents = [
        "// scan-ignore FE001\ntodo!();\ntodo!();",
        "todo!(); // scan-ignore debug\npanic!();",
        "/* scan-ignore-file todo-macro, FE004 */\n\n\ntodo!();\npanic!();\ndbg!(1);",
        "x(); // scan-ignore ALL\ntodo!();",
        "// scan-ignore FE001 FE777 fe002\nlet _ = 1;",
        "dbg!(1); // scan-ignore FE001\ntodo!();\n\ntodo!();",
    ]
    assert find(spark, *contents) == [["FE001 3:1"], [], ["FE003 6:1", "FE066 1:1", "FE066 1:1"][:1] + ["FE066 1:1"], [], ["FE066 1:1"] * 3, ["FE001 4:1", "FE003 1:1"]]
    rescan = find(spark, contents[0], contents[2], contents[4], settings=Settings(dead_suppressions="rescan"))
    assert rescan == [["FE001 3:1"], ["FE003 6:1"], ["FE066 1:1"] * 3]


def test_prefilter_changes_results(spark):
    content = 'fn f() { RegexBuilder::new(pattern); self::go(); }'
    assert find(spark, content) == [[]]
    assert find(spark, content, settings=Settings(prefilter=False)) == [["FE079 1:38", "FE082 1:28"]]


def test_severity_override_and_null_content(spark):
    files = spark.createDataFrame([("a.rs", "todo!();"), ("b.rs", None)], "path string, content string")
    rows = scan(files, Settings(severity={"FE001": "critical"})).collect()
    assert [(r["rule_id"], r["severity"], r["snippet"]) for r in rows] == [("FE001", "critical", "todo!();")]
    assert scan(files.where("false")).collect() == []
