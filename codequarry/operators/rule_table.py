"""The rule dimension: what each rule is called, how grave it is, what it says."""

from __future__ import annotations

from dataclasses import dataclass

from pyspark.sql import DataFrame, SparkSession

from codequarry.operators.settings import Settings


@dataclass(frozen=True)
class Rule:
    rule_id: str
    rule_name: str
    category: str
    severity: str
    description: str
    suggestion: str | None
    suggestion_example: str | None
    signatures: tuple[str, ...]


SEVERITIES = ("info", "warning", "high", "critical")
CATEGORIES = ("debug", "unsafe", "secrets", "lint", "regex", "shell", "path")

# Fixed values, in registry order: id, name, category, severity, description, suggestion, example, prefilter signatures.
# {directive} and {product} stand for settings. FE040 to FE044 are reconstructed from what is known of them; their wording and severity are our own.
_ROWS = [
    ("FE001", "todo-macro", "debug", "warning", "todo!() marks unfinished code and panics at runtime", "Implement the code path or remove the placeholder macro.", "before: todo!();\nafter: return Err(MyError::Unimplemented);", ["todo"]),
    ("FE002", "unimplemented-macro", "debug", "warning", "unimplemented!() marks unfinished code and panics at runtime", "Implement the code path or remove the placeholder macro.", "before: todo!();\nafter: return Err(MyError::Unimplemented);", ["unimplemented"]),
    ("FE003", "dbg-macro", "debug", "warning", "dbg!() is a debugging aid that should not ship in production code", "Remove the debug macro or replace it with intentional logging.", "before: dbg!(value);\nafter: tracing::debug!(?value);", ["dbg"]),
    ("FE004", "panic-macro", "debug", "warning", "panic!() aborts the current thread; prefer recoverable error handling", "Prefer returning a Result or handling the error explicitly.", "before: panic!(\"bad input\");\nafter: return Err(MyError::BadInput);", ["panic"]),
    ("FE020", "unsafe-usage", "unsafe", "info", "`unsafe` code bypasses Rust's safety guarantees and deserves review", "Isolate unsafe code behind a safe abstraction and document the safety invariants.", "before: unsafe { ptr.read() }\nafter: // SAFETY: ptr is valid and aligned\nlet value = unsafe { ptr.read() };", ["unsafe"]),
    ("FE021", "unsafe-fn", "unsafe", "warning", "`unsafe fn` pushes safety obligations onto every caller", "Prefer a safe function if possible, or document the caller obligations in a Safety section.", "before: pub unsafe fn from_raw(p: *const u8) -> T\nafter: /// # Safety\n/// `p` must point to ...\npub unsafe fn from_raw(p: *const u8) -> T", ["unsafe", "fn"]),
    ("FE040", "hardcoded-password", "secrets", "high", "a password literal in source code is readable by everyone who has the code", "Read the password from the environment or a secret store.", None, ['"']),
    ("FE041", "hardcoded-api-key", "secrets", "high", "an API key literal in source code is readable by everyone who has the code", "Read the key from the environment or a secret store.", None, ['"']),
    ("FE042", "hardcoded-secret", "secrets", "high", "a secret literal in source code is readable by everyone who has the code", "Read the secret from the environment or a secret store.", None, ['"']),
    ("FE043", "hardcoded-token", "secrets", "high", "a token literal in source code is readable by everyone who has the code", "Read the token from the environment or a secret store.", None, ['"']),
    ("FE044", "hardcoded-credential-url", "secrets", "high", "a URL with credentials in source code gives them to everyone who has the code", "Take the credentials out of the URL and read them at run time.", None, ["://"]),
    ("FE060", "manual-clamp", "lint", "info", "manual clamp-like min/max chains are harder to read than `.clamp(...)`", "Replace the chained min/max expression with `.clamp(lower, upper)` when the bounds are known.", "before: v.max(min).min(max)\nafter: v.clamp(min, max)", [".max(", ".min("]),
    ("FE061", "empty-doc-comment", "lint", "warning", "empty doc comments add noise without documenting behavior", "Write a short summary for the item or remove the empty doc comment.", "before: ///\nafter: /// Returns the parsed configuration.", ["///", "//!"]),
    ("FE062", "empty-comment", "lint", "info", "empty comments add visual noise without explaining anything", "Remove the empty comment or replace it with a useful explanation.", "before: //\nafter: // Keep this branch for backward compatibility.", ["//", "/*"]),
    ("FE063", "unused-variable", "lint", "warning", "unused variables are a sign of dead code or a missed refactor", "Remove the variable or prefix it with an underscore if it is intentionally unused.", "before: let value = compute();\nafter: let _value = compute();", ["let"]),
    ("FE064", "unused-constant", "lint", "warning", "unused constants often indicate dead code or stale configuration", "Remove the constant or use it at every call site that needs it.", "before: const MAX_RETRY: usize = 3;\nafter: let retries = MAX_RETRY;", ["const"]),
    ("FE065", "test-without-product-reference", "lint", "warning", "tests that never reference product code can become disconnected from real behavior", "Reference crate/module code in test bodies so assertions validate real behavior.", "before: #[test] fn t(){ assert_eq!(2,1+1); }\nafter: #[test] fn t(){ assert!(crate::parser::parse(\"x\").is_ok()); }", ["test"]),
    ("FE066", "dead-suppression-comment", "lint", "info", "suppression comments for rule IDs with no matching findings create stale lint policy", "Remove stale {directive} IDs or replace them with active rule IDs.", "before: // {directive} FE999\nafter: // remove stale suppression", ["{directive}"]),
    ("FE075", "assert-only-tests-without-product-calls", "lint", "warning", "assert-only tests that never call product code can pass without validating behavior", "Call crate/module code inside each test and assert on real outputs.", "before: #[test] fn t() { assert_eq!(2, 1 + 1); }\nafter: #[test] fn t() { assert!(crate::parser::parse(\"x\").is_ok()); }", ["test", "assert"]),
    ("FE078", "test-without-assertions", "lint", "warning", "tests that call product code but never assert on outputs or effects can silently pass", "Assert on a concrete output, error, or side effect so the test validates behavior.", "before: #[test] fn t() { crate::parser::parse(\"x\"); }\nafter: #[test] fn t() { assert!(crate::parser::parse(\"x\").is_ok()); }", ["test"]),
    ("FE079", "ignored-product-call-result", "lint", "info", "product-code calls whose results are silently dropped often hide unchecked failures", "Use the returned value, assert on it, or bind it explicitly with `let _ =` to show the drop is intentional.", "before: crate::parser::parse(\"x\");\nafter: assert!(crate::parser::parse(\"x\").is_ok());", ["crate", "super", "{product}"]),
    ("FE076", "unwrap-expect-outside-tests", "lint", "warning", "unwrap/expect calls outside tests can turn recoverable failures into crashes", "Handle the error explicitly or propagate it with `?` instead of using unwrap/expect in non-test code.", "before: let cfg = read_config().unwrap();\nafter: let cfg = read_config()?;", ["unwrap", "expect"]),
    ("FE077", "error-erasure", "lint", "warning", "mapping all errors to `_` erases useful debugging context", "Preserve the original error context or include it in the mapped error value.", "before: result.map_err(|_| MyError::BadInput)\nafter: result.map_err(|err| MyError::BadInputWithSource(err.to_string()))", ["map_err", "or_else"]),
    ("FE080", "nested-regex-quantifier", "regex", "warning", "nested quantifiers can make a regex hard to reason about and expensive in some engines", "Rewrite the pattern to avoid repeating a group that already contains a quantifier.", "before: (a+)+$\nafter: a+$", ["regex"]),
    ("FE081", "suspicious-regex", "regex", "info", "overly broad wildcards and empty alternations make regexes harder to maintain", "Tighten the pattern by replacing broad wildcards or removing empty alternation branches.", "before: .*token.*.*\nafter: ^[A-Za-z0-9_]*token[A-Za-z0-9_]*$", ["regex"]),
    ("FE082", "dynamic-regex", "regex", "high", "building regex patterns from runtime input or formatting is a common source of bugs and injection risk", "Prefer a fixed regex literal and validate user input separately before matching.", "before: Regex::new(format!(\"{}\", user))\nafter: Regex::new(r\"^[a-z]+$\")", ["regex"]),
    ("FE083", "unanchored-validation-regex", "regex", "info", "validation regexes that lack anchors can accept partial matches unexpectedly", "Anchor the pattern with `^...$` if the regex is meant to validate the entire input.", "before: re.is_match(r\"[a-z]+\")\nafter: re.is_match(r\"^[a-z]+$\")", ["is_match", "captures"]),
    ("FE100", "command-execution", "shell", "info", "spawning an external process is worth reviewing for argument and input handling", "Pass arguments individually via `.arg()` and avoid invoking a shell unless required.", "before: Command::new(\"sh\").arg(\"-c\").arg(cmd)\nafter: Command::new(\"ls\").arg(\"-la\")", ["command"]),
    ("FE101", "shell-string-injection", "shell", "high", "invoking a shell with a dynamically built command string is a common injection vector", "Avoid building shell command strings from dynamic input; pass arguments individually via `.arg()` instead of invoking a shell.", "before: .arg(format!(\"echo {}\", user))\nafter: .arg(\"echo\").arg(user)", ["command", "sh", "bash", "powershell", "cmd"]),
    ("FE120", "path-traversal-literal", "path", "high", "a literal `..` path segment can escape the intended base directory", "Reject or normalize path segments containing `..` before joining them onto a base directory.", "before: base.join(\"../secret\")\nafter: if segment.contains(\"..\") { return Err(e); }", ["join", "push", "pathbuf"]),
    ("FE121", "unsanitized-path-input", "path", "warning", "joining a path with a variable that looks like untrusted input can allow path traversal", "Validate or canonicalize path segments derived from external input before joining them onto a base directory.", "before: base.join(user_input)\nafter: base.join(sanitize_segment(user_input)?)", ["join", "push"]),
    ("FE122", "archive-entry-path-traversal", "path", "high", "joining archive entry names into destination paths without validation can allow traversal during extraction", "Validate archive entry paths and reject absolute or `..` segments before joining them onto an extraction destination.", "before: let out = dest.join(archive_entry_path);\nafter: let out = dest.join(sanitize_archive_entry(archive_entry_path)?);", ["join", "push", "archive", "extract", "zip", "tar"]),
]


def all_rules(settings: Settings = Settings()) -> list[Rule]:
    """Every rule, in registry order."""

    def fill(text: str | None) -> str | None:
        return text and text.replace("{directive}", settings.directive).replace("{product}", settings.product)

    return [Rule(settings.rule_prefix + i[2:], n, c, s, d, fill(h), fill(e), tuple(fill(x) for x in sig)) for i, n, c, s, d, h, e, sig in _ROWS]


def enabled_rules(settings: Settings) -> list[Rule]:
    """The rules that run: an explicit toggle wins over its category's, both default to on; then the lists of ids and categories."""
    if settings.maximum:
        return all_rules(settings)

    def on(rule: Rule) -> bool:
        toggled = settings.rules.get(rule.rule_id, settings.rulesets.get(rule.category, True))
        named = not settings.only_rules or rule.rule_id in {r.upper() for r in settings.only_rules}
        return toggled and named and (not settings.only_categories or rule.category in settings.only_categories)

    return [r for r in all_rules(settings) if on(r)]


def rule_frame(spark: SparkSession, rules: list[Rule]) -> DataFrame:
    """The rule dimension as a table; ordinal is the registry order."""
    rows = [(n, r.rule_id, r.rule_name, r.category, r.severity, r.description, r.suggestion, r.suggestion_example, list(r.signatures)) for n, r in enumerate(rules)]
    return spark.createDataFrame(rows, "ordinal int, rule_id string, rule_name string, category string, severity string, description string, suggestion string, suggestion_example string, signatures array<string>")


def explain_rule(rules: list[Rule], rule_id: str) -> str | None:
    """The text that describes one rule; None for an unknown id, whatever its case."""
    for r in rules:
        if r.rule_id == rule_id.upper():
            lines = [f"{r.rule_id} — {r.rule_name}", f"Category: {r.category}", f"Severity: {r.severity}", f"Description: {r.description}"]
            return "\n".join([*lines, *([f"Suggestion: {r.suggestion}"] if r.suggestion else [])]) + "\n"
    return None


def rule_index(rules: list[Rule]) -> str:
    return "".join(f"{r.rule_id}  {r.severity:<8}  {r.category:<8}  {r.rule_name}\n" for r in rules)
