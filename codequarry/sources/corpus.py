"""Corpora as files(path, content): from directories, from text tables, and a synthetic one whose lines come from key arithmetic over lineitem."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F
from codequarry.session import partitions_for

#: snippets of a ferry line's programs that the synthetic corpus draws from; {k} is the row's part key. Some are deep, long or end inside a construct
TEMPLATES = [
    "let berth_{k} = harbour::assign(\"pier {k}\", 4);",
    "        todo!(\"tariff table for zone {k}\")",
    "// the tide table says todo!() but nobody minds",
    "std::panic!(\"hull number {k} is taken\");",
    "let wärme = dbg!(gauge_{k}.celsius()) + 0.5;",
    "unimplemented!(); // scan-ignore unimplemented-macro",
    "/* scan-ignore lint, debug */ dbg!(anchor_{k});",
    "fn sail_{k}(crew: u32) -> u32 {\n    let knots = crew * {k};\n    let spare = 1;\n    knots\n}",
    "unsafe fn read_sonar_{k}(port: *const u8) -> u8 { *port }",
    "let depth = unsafe { *sonar_{k} };",
    "    ///",
    "    /// Fare of route {k}, in cents.\n    ///\n    /// Children pay half.",
    "  //",
    "/**/ let quay = {k}; moor(quay);",
    "const ADMIN_PASSWORD: &str = \"tide-{k}-low\";",
    "    pub static FERRY_API_KEY: &str = r\"fk-{k}\";",
    "settings.client_secret = \"salt{k}\"; // scan-ignore hardcoded-secret",
    "let boarding_token: String = \"b{k}\".into();",
    "send(\"xoxb-{k}-abcdefghij\");",
    "let dsn = \"mysql://clerk:tide{k}@ledger.example:3306/tickets\";",
    "let speed = wind_{k}\n    .min(ceiling)\n    .max(floor);",
    "let list = manifest_{k}.lines().next().expect(\"a first line\");",
    "let hold = cargo_{k}.weigh().or_else(|_| estimate())?;",
    "let seats = match plan_{k}.parse::<u16>() { Ok(n) => n, Err(e) => panic!(\"{e}\") };",
    "super::ledger::post(entry_{k});",
    "if late { crate::horn::blow({k}) };\nself::deck::clear();",
    "let lane = Regex::new(\"([A-Z]+[0-9]*)+-{k}\").expect(\"lane\");",
    "static ROUTE: Lazy<Regex> = lazy(|| regex::Regex::new(r#\"(north|south|)\"#).unwrap());",
    "let buoy = RegexBuilder::new(&[\"light\", shade_{k}].join(\"|\"))\n    .case_insensitive(true)\n    .build();",
    "let ok = Regex::new(concat!(\"^b\", \"[0-9]+$\")).unwrap().is_match(berth_{k});",
    "fn valid_berth(s: &str) -> bool {\n    Regex::new(\"b[0-9]{3}\").unwrap().is_match(s)\n}",
    "// find the captain's name\nlet hit = Regex::new(r\"capt\\.\").unwrap().captures(log_{k});",
    "let out = process::Command::new(\"gangway\").args([\"--down\", \"{k}\"]).status();",
    "Command::new(\"bash\")\n    .arg(\"-c\")\n    .arg(String::from(\"bell \") + &count_{k}.to_string())\n    .spawn();",
    "let mast = std::env::args().nth({k});\nCommand::new(\"pwsh\").arg(\"-Command\").arg(mast);",
    "let chart = root.join(\"charts/../../private/{k}\");",
    "stack.push(\"../{k}\");",
    "open(PathBuf::from(\"../../bilge/{k}.log\"));",
    "let slip = docks.join(request_{k}.berth());",
    "for file in cargo_zip.files() {\n    let spot = hold.join(file.file_name());\n    write(spot);\n}",
    "let spot = hold.join(header_{k}.path());\nlet real = spot.canonicalize()?;\nassert!(real.starts_with(&hold)); // untar",
    "pub const DRAUGHT_{k}: f32 = 3.5;\nconst LENGTH: [u8; 2] = [DRAUGHT_{k} as u8, 1];",
    "#[test]\nfn tides_turn_{k}() {\n    let high = 3;\n    assert!(high > 2, \"low\");\n    assert_ne!(high, {k});\n}",
    "#[test]\nfn horn_sounds_{k}() {\n    product::horn::blow({k});\n}",
    "#[async_std::test]\n#[should_panic(expected = \"]\")]\nfn fog_{k}() { debug_assert_eq!(crate::fog::depth(), 9); }",
    "let (bow, Stern { keel: mut rudder, .. }, [first_{k}, ..]) = hull; steer(bow);",
    "// scan-ignore-file shell-string-injection, FE020",
    "// scan-ignore FE404 FE061,\tfe100",
    "let bell = {k};\r\nring(bell);\r",
    "/* outer /* inner {k} */ x.unwrap(); */ let mid = 1; use_it(mid);",
    "/* " * 36 + "deep_{k}.unwrap();" + " */" * 36,
    "let sum = f(g(h(i(j(k(l(m({k}))))))));\nadd(sum);",
    "let gate = base.join(a(b(c(d(e(f(\"..\"))))))).exists();",
    "let knot = regex::Regex::new(&wrap(wrap(wrap(wrap(wrap(wrap(part_{k})))))));",
    "let raw = r##\"unsafe { \"#tide {k}\"# }\"##; show(raw);",
    "'outer: loop { break 'outer; }",
    "let s = \"first\nlet inner = {k}; // not a comment\nlast\"; print(s);",
    "let esc = \"quote \\\" and slash \\\\\"; log(esc, '\\'', '\"');",
    "    let x = {k};\n    {\n        let x = x + 1;\n        show(x);\n    }\n    let y = x;",
    "fn dock_{k}() -> Dock { unimplemented!(\"dock {k}\") }",
    "let galley_secret: &str = \"soup {k}\";",
    "impl Dock {\n    pub const CAP: usize = {k};\n    fn cap(&self) -> usize { Self::CAP }\n}",
    "log(" + " + ".join(f"leg_{n}({{k}})" for n in range(60)) + ").unwrap_err();",
]


def synthetic_code(spark: SparkSession, sf_dir: str) -> DataFrame:
    """One source file for each order of lineitem, a template for each of its rows; every third file ends with a newline."""
    items = spark.read.parquet(f"{sf_dir}/lineitem.parquet")
    rows = items.select("l_orderkey", F.struct("l_linenumber", "l_partkey", "l_suppkey").alias("row"))

    def text(row: Column) -> Column:
        n = (row["l_partkey"] * 7 + row["l_suppkey"] * 3 + row["l_linenumber"]) % len(TEMPLATES)
        return F.replace(F.element_at(F.array(*map(F.lit, TEMPLATES)), n.cast("int") + 1), F.lit("{k}"), row["l_partkey"].cast("string"))

    # equal keys have equal texts, so the keys alone are dealt and give the order; in a given number of partitions, for few bytes of keys make many of text
    joined = rows.repartition(partitions_for(items), "l_orderkey").groupBy("l_orderkey").agg(F.array_join(F.transform(F.array_sort(F.collect_list("row")), text), "\n").alias("content"))
    key = F.col("l_orderkey")
    path = F.concat(F.when(key % 11 == 0, "tests/").otherwise("src/"), F.lit("f"), key.cast("string"), F.lit(".rs"))
    return joined.select(path.alias("path"), F.when(key % 3 == 0, F.concat("content", F.lit("\n"))).otherwise(F.col("content")).alias("content"))
