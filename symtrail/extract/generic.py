"""Other languages by one lexer and a table of rules each.

Comments and strings are blanked out, keeping every position. Definitions are found by patterns per
language; scopes by matching brackets (by indentation in F#, by `end` in Ruby). This is not a full
parser: what a language's rules don't name is not found. Differences are listed in the README.
"""

from __future__ import annotations

import bisect
import re
from typing import NamedTuple

IDENT = r"[A-Za-z_$][\w$]*"


class Rules(NamedTuple):
    separator: str
    definitions: tuple[tuple[str, str], ...]  # kind, pattern with group `name` (and `bases`)
    opens: tuple[str, ...]
    default: str  # visibility
    private: str = r"\bprivate\b|\bfileprivate\b"
    internal: str = r"\binternal\b|\bprotected\b"
    public: str = r"\bpublic\b|\bopen\b"
    line_comment: str = "//"
    block: tuple[str, str] = ("/*", "*/")
    scope: str = "braces"
    package: str | None = None


_MODS = r"(?:(?:public|private|protected|internal|static|final|abstract|sealed|partial|async|override|virtual|readonly|open|data|inline|suspend|export|default|declare|extern|unsafe|const|new|native|synchronized|fileprivate|mutating|lateinit|companion|enum|annotation|inner|operator|infix|extends|dynamic|macro|strictfp)\s+)*"
_BASES = r"(?:\s*(?:<[^>{]*>)?\s*(?:\([^)]*\)\s*)?(?P<how>:|extends|implements|<)\s*(?P<bases>[^{\n;]*))?"
_WORDS = "if else for while do switch case return break continue new class interface struct enum namespace using import package public private protected internal static final void int char bool boolean float double long short string var let const function func fun def end module begin rescue ensure unless until then this self super null nil true false None try catch finally throw throws in is as of typeof instanceof async await yield export default from extends implements override abstract sealed readonly where when match with impl fn pub use mod mut trait type crate ref move dyn unsafe extern static val object companion data open init struct protocol extension guard defer repeat some any inout go chan select range map echo print fallthrough goto require include".split()

# How each language writes its definitions and imports.
RULES: dict[str, Rules] = {
    "c": Rules("::", (("class", rf"\bstruct\s+(?P<name>{IDENT})\s*(?=\{{)"), ("union", rf"\b(?:union|enum)\s+(?P<name>{IDENT})\s*(?=\{{)"), ("type", rf"\btypedef\b[^;{{}}]*?(?P<name>{IDENT})\s*;"), ("value", rf"^[ \t]*#\s*define\s+(?P<name>{IDENT})"), ("function", rf"^(?!\s*(?:return|else|typedef)\b)[ \t]*[A-Za-z_][\w\s*]*?[\s*](?P<name>{IDENT})\s*\([^;{{}}()]*\)\s*(?=\{{)")), (r'^[ \t]*#\s*include\s*["<]([^">]+)[">]',), "public", private=r"\bstatic\b"),
    "cpp": Rules("::", (("module", rf"\bnamespace\s+(?P<name>{IDENT})\s*(?=\{{)"), ("class", rf"\b(?:class|struct)\s+(?P<name>{IDENT})(?:\s*final)?(?:\s*:\s*(?P<bases>[^{{;]*))?\s*(?=\{{)"), ("union", rf"\benum\s+(?:class\s+)?(?P<name>{IDENT})[^;{{]*(?=\{{)"), ("function", rf"^(?!\s*(?:return|else|using|typedef)\b)[ \t]*(?:[\w:<>,&*~\s]+?[\s*&])?(?P<name>~?{IDENT})\s*\([^;{{}}()]*\)\s*(?:const|noexcept|override|\s)*(?=\{{)")), (r'^[ \t]*#\s*include\s*["<]([^">]+)[">]', r"\busing\s+namespace\s+([\w:]+)", r"\busing\s+([\w:]+)\s*;"), "public"),
    "csharp": Rules(".", (("module", r"\bnamespace\s+(?P<name>[\w.]+)\s*(?=[{;])"), ("class", rf"\bclass\s+(?P<name>{IDENT}){_BASES}"), ("interface", rf"\binterface\s+(?P<name>{IDENT}){_BASES}"), ("record", rf"\b(?:struct|record)\s+(?:class\s+|struct\s+)?(?P<name>{IDENT}){_BASES}"), ("union", rf"\benum\s+(?P<name>{IDENT})"), ("function", rf"(?:^|(?<=[{{}};]))[ \t]*{_MODS}[\w<>\[\],.?]+\s+(?P<name>{IDENT})\s*(?:<[^>]*>)?\([^;{{}}]*\)\s*(?=\{{|=>)")), (r"^[ \t]*using\s+(?:static\s+)?([\w.]+)\s*;",), "private"),
    "fsharp": Rules(".", (("module", r"^[ \t]*(?:module|namespace)\s+(?:rec\s+|private\s+|internal\s+)?(?P<name>[\w.]+)"), ("type", rf"^[ \t]*type\s+(?:private\s+|internal\s+)?(?P<name>{IDENT})"), ("function", rf"^[ \t]*let\s+(?:rec\s+|inline\s+|private\s+|internal\s+|mutable\s+)*(?P<name>{IDENT})\s+(?=[\w(])"), ("value", rf"^[ \t]*let\s+(?:mutable\s+|private\s+|internal\s+)*(?P<name>{IDENT})\s*(?=[:=])"), ("function", rf"^[ \t]*(?:static\s+)?(?:member|override|abstract)\s+(?:inline\s+|private\s+|internal\s+)*(?:\w+\.)?(?P<name>{IDENT})")), (r"^[ \t]*open\s+([\w.]+)",), "public", block=("(*", "*)"), scope="indent"),
    "go": Rules(".", (("class", rf"\btype\s+(?P<name>{IDENT})\s+struct\b"), ("interface", rf"\btype\s+(?P<name>{IDENT})\s+interface\b"), ("type", rf"\btype\s+(?P<name>{IDENT})\s+(?!struct|interface)\S"), ("function", rf"^func\s+(?:\(\s*\w*\s*\*?(?P<receiver>\w+)[^)]*\)\s*)?(?P<name>{IDENT})\s*[\[(]"), ("value", rf"^(?:const|var)\s+(?P<name>{IDENT})\b")), (r'^[ \t]*import\s+(?:\w+\s+)?"([^"]+)"', r'^[ \t]+(?:\w+\s+)?"([^"]+)"[ \t]*$'), "public", package=rf"^package\s+({IDENT})"),
    "haxe": Rules(".", (("class", rf"\bclass\s+(?P<name>{IDENT}){_BASES}"), ("interface", rf"\binterface\s+(?P<name>{IDENT}){_BASES}"), ("type", rf"\btypedef\s+(?P<name>{IDENT})"), ("function", rf"\bfunction\s+(?P<name>{IDENT})"), ("value", rf"\bvar\s+(?P<name>{IDENT})")), (r"^[ \t]*(?:import|using)\s+([\w.]+)",), "private", package=r"^[ \t]*package\s+([\w.]+)"),
    "java": Rules(".", (("class", rf"\b(?:class|record)\s+(?P<name>{IDENT}){_BASES}"), ("interface", rf"(?:\binterface|@interface)\s+(?P<name>{IDENT}){_BASES}"), ("union", rf"\benum\s+(?P<name>{IDENT}){_BASES}"), ("function", rf"(?:^|(?<=[{{}};]))[ \t]*{_MODS}(?:<[^>]*>\s*)?(?:[\w<>\[\],.?]+\s+)?(?P<name>{IDENT})\s*\([^;{{}}]*\)\s*(?:throws[\w\s,.]*)?(?=\{{)"), ("value", rf"(?:^|(?<=[{{}};]))[ \t]*{_MODS}[\w<>\[\],.?]+\s+(?P<name>{IDENT})\s*(?:=[^;]*)?;")), (r"^[ \t]*import\s+(?:static\s+)?([\w.*]+)\s*;",), "internal", package=r"^[ \t]*package\s+([\w.]+)", internal=r"\bprotected\b"),
    "javascript": Rules(".", (("class", rf"\bclass\s+(?P<name>{IDENT})(?:\s+extends\s+(?P<bases>[\w.$]+))?"), ("function", rf"\bfunction\s*\*?\s+(?P<name>{IDENT})"), ("function", rf"\b(?:const|let|var)\s+(?P<name>{IDENT})\s*=\s*(?:async\s*)?(?:\([^)]*\)|{IDENT})\s*=>"), ("value", rf"^[ \t]*(?:export\s+)?(?:const|let|var)\s+(?P<name>{IDENT})\s*="), ("function", rf"^[ \t]+(?:static\s+|async\s+|get\s+|set\s+)*(?P<name>{IDENT})\s*\([^;{{}}()]*\)\s*(?=\{{)"), ("function", rf"\.prototype\.(?P<name>{IDENT})\s*=")), (r"""\bfrom\s+['"]([^'"]+)['"]""", r"""\brequire\(\s*['"]([^'"]+)['"]""", r"""^[ \t]*import\s+['"]([^'"]+)['"]"""), "private", public=r"\bexport\b"),
    "kotlin": Rules(".", (("interface", rf"\binterface\s+(?P<name>{IDENT}){_BASES}"), ("union", rf"\benum\s+class\s+(?P<name>{IDENT})"), ("class", rf"\b(?<!enum )(?:class|object)\s+(?P<name>{IDENT}){_BASES}"), ("function", rf"\bfun\s+(?:<[^>]*>\s*)?(?:[\w.<>]+\.)?(?P<name>{IDENT})\s*\("), ("value", rf"\b(?:val|var)\s+(?P<name>{IDENT})\b"), ("type", rf"\btypealias\s+(?P<name>{IDENT})")), (r"^[ \t]*import\s+([\w.*]+)",), "public", package=r"^[ \t]*package\s+([\w.]+)"),
    "objc": Rules(".", (("class", rf"^[ \t]*@(?:interface|implementation)\s+(?P<name>{IDENT})(?:\s*:\s*(?P<bases>\w+))?"), ("interface", rf"^[ \t]*@protocol\s+(?P<name>{IDENT})"), ("function", rf"^[ \t]*[-+]\s*\([^)]*\)\s*(?P<name>{IDENT})"), ("member", rf"^[ \t]*@property\b[^;]*?(?P<name>{IDENT})\s*;"), ("function", rf"^[A-Za-z_][\w\s*]*?[\s*](?P<name>{IDENT})\s*\([^;{{}}()]*\)\s*(?=\{{)")), (r'^[ \t]*#\s*(?:import|include)\s*["<]([^">]+)[">]', r"^[ \t]*@import\s+([\w.]+)"), "public", scope="at_end"),
    "php": Rules("\\", (("class", rf"\bclass\s+(?P<name>{IDENT})(?:\s+(?P<how>extends|implements)\s+(?P<bases>[\w\\,\s]+))?"), ("interface", rf"\binterface\s+(?P<name>{IDENT})"), ("module", rf"\btrait\s+(?P<name>{IDENT})"), ("union", rf"\benum\s+(?P<name>{IDENT})"), ("function", rf"\bfunction\s+&?(?P<name>{IDENT})\s*\("), ("value", rf"\bconst\s+(?P<name>{IDENT})\s*=")), (r"^[ \t]*use\s+([\w\\]+)",), "public", package=r"^[ \t]*namespace\s+([\w\\]+)"),
    "ruby": Rules("::", (("class", r"^[ \t]*class\s+(?P<name>[A-Z][\w:]*)(?:\s*<\s*(?P<bases>[\w:]+))?"), ("module", r"^[ \t]*module\s+(?P<name>[A-Z][\w:]*)"), ("function", r"^[ \t]*def\s+(?:self\.)?(?P<name>[\w]+[?!=]?)"), ("value", r"^[ \t]*(?P<name>[A-Z][A-Z0-9_]*)\s*=(?!=)"), ("member", r"^[ \t]*attr_(?:reader|writer|accessor)\s+:(?P<name>\w+)")), (r"""^[ \t]*(?:require|require_relative|load)\s*\(?\s*['"]([^'"]+)['"]""",), "public", line_comment="#", block=("=begin", "=end"), scope="end"),
    "rust": Rules("::", (("module", rf"\bmod\s+(?P<name>{IDENT})\s*(?=\{{)"), ("function", rf"\bfn\s+(?P<name>{IDENT})"), ("class", rf"\bstruct\s+(?P<name>{IDENT})"), ("union", rf"\benum\s+(?P<name>{IDENT})"), ("interface", rf"\btrait\s+(?P<name>{IDENT})"), ("value", rf"\b(?:const|static)\s+(?:mut\s+)?(?P<name>{IDENT})\s*:"), ("type", rf"\btype\s+(?P<name>{IDENT})"), ("function", rf"\bmacro_rules!\s+(?P<name>{IDENT})")), (r"^[ \t]*(?:pub\s+)?use\s+([^;]+);",), "private", public=r"\bpub\b(?!\s*\()", internal=r"\bpub\s*\(", private=r"\bprivate\b"),
    "swift": Rules(".", (("class", rf"\bclass\s+(?!func|var)(?P<name>{IDENT}){_BASES}"), ("record", rf"\bstruct\s+(?P<name>{IDENT}){_BASES}"), ("union", rf"\benum\s+(?P<name>{IDENT}){_BASES}"), ("interface", rf"\bprotocol\s+(?P<name>{IDENT}){_BASES}"), ("function", rf"\bfunc\s+(?P<name>{IDENT})"), ("value", rf"\b(?:let|var)\s+(?P<name>{IDENT})\b"), ("type", rf"\btypealias\s+(?P<name>{IDENT})")), (r"^[ \t]*import\s+([\w.]+)",), "internal"),
}
RULES["typescript"] = RULES["javascript"]._replace(
    definitions=(("class", rf"\bclass\s+(?P<name>{IDENT})(?:<[^>{{]*>)?(?:\s+extends\s+(?P<bases>[\w.$]+))?"), ("interface", rf"\binterface\s+(?P<name>{IDENT})"), ("type", rf"^[ \t]*(?:export\s+)?type\s+(?P<name>{IDENT})\s*[=<]"), ("union", rf"\benum\s+(?P<name>{IDENT})"), ("module", rf"\bnamespace\s+(?P<name>{IDENT})"), *RULES["javascript"].definitions[1:]),
)
# Which comments are docs in each language: the marker of line comments, that of blocks.
DOCS: dict[str, tuple[str | None, str | None]] = {
    "c": ("//", "/*"), "cpp": ("//", "/*"), "csharp": ("///", None), "fsharp": ("///", None), "go": ("//", "/*"), "haxe": ("///", "/**"), "java": (None, "/**"),
    "javascript": ("//", "/**"), "kotlin": (None, "/**"), "objc": ("///", "/**"), "php": (None, "/**"), "ruby": ("#", None), "rust": ("///", None),
    "swift": ("///", "/**"), "typescript": ("//", "/**"),
}
#: How annotations are written, alone on a line or before a definition.
ATTRIBUTES = {
    "csharp": r"\[[A-Za-z][^\]\n]*\]", "fsharp": r"\[<[^\n]*?>\]", "haxe": r"@:?[\w.]+(?:\([^()\n]*\))?", "java": r"@(?!interface\b)[\w.]+(?:\([^()\n]*\))?", "kotlin": r"@[\w.:]+(?:\([^()\n]*\))?",
    "php": r"#\[[^\]\n]*\]", "rust": r"#!?\[[^\n]*?\](?=\s|$)", "swift": r"@[\w.]+(?:\([^()\n]*\))?", "typescript": r"@[\w.]+(?:\([^()\n]*\))?", "javascript": r"@[\w.]+(?:\([^()\n]*\))?",
}
_SCOPES = ("module", "class", "interface", "record", "union", "type")


def blanked(source: str, rules: Rules) -> tuple[str, str]:
    """The source without comments, and also without what strings hold; positions don't change."""
    spaces = lambda m: re.sub(r"[^\n]", " ", m.group())
    a, b = map(re.escape, rules.block)
    string = r"\"(?:\\.|[^\"\\\n])*\"|'(?:\\.|[^'\\\n])*'|`(?:\\.|[^`\\])*`"
    comment = rf"{a}[\s\S]*?(?:{b}|\Z)|{re.escape(rules.line_comment)}[^\n]*"
    keep = rf"(?P<keep>^[ \t]*#\s*(?:include|define|import)[^\n]*|{string})|{comment}" if rules.line_comment != "#" else rf"(?P<keep>{string})|{comment}"
    code = re.sub(keep, lambda m: m.group() if m.group("keep") else spaces(m), source, flags=re.M)
    return code, re.sub(string, spaces, code)


def _ends(code: str, rules: Rules, starts: list[int]) -> dict[int, int]:
    """Where the scope that begins at each place ends."""
    out: dict[int, int] = {}
    if rules.scope == "braces":
        closing: dict[int, int] = {}
        stack: list[int] = []
        opening: list[int] = []
        for i, c in enumerate(code):
            if c == "{":
                stack.append(i)
                opening.append(i)
            elif c == "}" and stack:
                closing[stack.pop()] = i
        for s in starts:
            at = bisect.bisect_left(opening, s)
            brace = opening[at] if at < len(opening) else -1
            stop = code.find(";", s)
            own = brace >= 0 and (stop < 0 or brace < stop)
            out[s] = closing.get(brace, len(code)) if own else (len(code) if code[s : stop + 1].lstrip().startswith("namespace") else s)
        return out
    if rules.scope == "at_end":
        return {s: (e if (e := code.find("@end", s)) >= 0 else len(code)) for s in starts}
    lines, at = code.split("\n"), 0
    places = []
    for text in lines:
        places.append((at, len(text) - len(text.lstrip()), text.strip()))
        at += len(text) + 1
    for s in starts:
        n = code.count("\n", 0, s)
        if places[n][2] == "" and n + 1 < len(places):
            n += 1
        indent, stop = places[n][1], len(code)
        for begin, own, text in places[n + 1 :]:
            if text and own <= indent and not (rules.scope == "end" and not text.startswith("end")):
                stop = begin
                break
        top = rules.scope == "indent" and re.match(r"(?:module|namespace)\s+[\w.]+\s*$", places[n][2]) and indent == 0
        out[s] = len(code) if top else stop
    return out


def above(lines: list[str], n: int, head: str, language: str) -> tuple[str | None, list[str] | None]:
    """The doc comment and the annotations of the definition on line n (from 0), of which head stands
    before the name: what is directly above it, annotations and docs in any order, no blank line."""
    line_mark, block_mark = DOCS[language]
    pattern = ATTRIBUTES.get(language)
    only = re.compile(rf"\s*(?:{pattern}\s*)+$") if pattern else None
    attributes = re.findall(pattern, head) if pattern else []
    docs: list[str] = []
    at = n - 1
    while at >= 0:
        text = lines[at].strip()
        if only is not None and only.match(lines[at]):
            attributes = re.findall(pattern, text) + attributes
        elif line_mark is not None and text.startswith(line_mark):
            docs.insert(0, text.lstrip(line_mark[0]).lstrip("!").strip())
        elif block_mark is not None and text.endswith("*/"):
            first = at
            while first > 0 and "/*" not in lines[first]:
                first -= 1
            block = "\n".join(lines[first : at + 1]).strip()
            if not block.startswith(block_mark):
                break
            body = [x.strip().lstrip("*").strip() for x in block.removesuffix("*/").lstrip("/").lstrip("*").split("\n")]
            docs = [x for x in body if x] + docs
            at = first
        else:
            break
        at -= 1
    return "\n".join(x for x in docs if x) or None, attributes or None


def _parents(how: str | None, bases: str | None, language: str) -> tuple[str | None, list[str]]:
    """The class that a definition extends, and the interfaces that it implements, as each language
    tells them apart: by word, by a call of the parent in Kotlin, by the I of the name in C#."""
    bare = lambda b: b.strip().split("(")[0].split("<")[0].split()[-1]
    extended, _, implemented = (bases or "").partition("implements") if how != "implements" else ("", "", bases or "")
    extended, implemented = ([b for b in x.split(",") if b.strip()] for x in (extended, implemented))
    if language == "kotlin":
        return next((bare(b) for b in extended if "(" in b), None), [bare(b) for b in extended if "(" not in b]
    names = [bare(b) for b in extended]
    is_interface = re.compile("^I[A-Z]")
    parent = next((b for b in names if not (language == "csharp" and is_interface.match(b))), None)
    return parent, [b for b in names if b != parent] + [bare(b) for b in implemented]


def extract(source: str, language: str, max_depth: int = 500) -> dict:
    rules = RULES[language]
    code, bare = blanked(source, rules)
    starts = [0, *(m.end() for m in re.finditer("\n", source))]
    def place(at: int) -> tuple[int, int]:
        line = bisect.bisect_right(starts, at)
        return line, len(source[starts[line - 1] : at].encode()) + 1

    found: dict[int, tuple] = {}
    for kind, pattern in rules.definitions:
        for m in re.finditer(pattern, bare, re.M):
            name = m.group("name")
            if name.rsplit(".", 1)[-1] in _WORDS or m.start("name") in found:
                continue
            groups = m.groupdict()
            found[m.start("name")] = (kind, name, m.start(), (groups.get("how"), groups.get("bases")), groups.get("receiver"))
    ends = _ends(bare, rules, [v[2] for v in found.values()])
    package = re.search(rules.package, code, re.M) if rules.package else None
    outer = [package.group(1)] if package else []
    symbols, scopes, lines = [], [], source.split("\n")
    for at in sorted(found):
        kind, name, start, bases, receiver = found[at]
        while scopes and start >= scopes[-1][0]:
            scopes.pop()
        if len(scopes) > max_depth:
            continue
        scope = [*outer, *(n for _, n, k in scopes if k in _SCOPES), *([receiver] if receiver else [])]
        if kind == "value" and any(k == "function" for _, _, k in scopes):
            continue  # a local
        line, column = place(at)
        line_start = starts[bisect.bisect_right(starts, start) - 1]
        head = bare[line_start : at + len(name)]
        if language == "go":
            visibility = "public" if name[:1].isupper() else "private"
        elif kind == "module" and language == "csharp":
            visibility = "public"
        else:
            default = "public" if language in ("javascript", "typescript") and kind == "function" and scopes and scopes[-1][2] == "class" else rules.default
            visibility = "private" if re.search(rules.private, head) else "internal" if re.search(rules.internal, head) else "public" if re.search(rules.public, head) else default
        parent, rest = _parents(*bases, language)
        separator = "#" if language == "ruby" and kind == "function" and scope and "self." not in bare[start:at] else "." if language == "ruby" and kind == "function" and scope else rules.separator
        qualified = rules.separator.join(scope) + (separator if scope else "") + name
        stop = source.find("\n", start)
        doc, attributes = above(lines, line - 1, source[line_start:at], language)
        symbols.append({
            "name": name.rsplit(".", 1)[-1] if kind == "module" else name, "qualified": qualified, "kind": kind, "line": line, "column": column,
            "end_line": line, "end_column": column + len(name.encode()), "visibility": visibility, "parent": parent or receiver,
            "mixins": None, "attributes": attributes, "implements": rest or None, "doc": doc,
            "signature": source[start : stop if stop >= 0 else len(source)].strip().rstrip("{").strip(),
        })
        scopes.append((ends[start], name, kind))
    opens: list[str] = []
    spots = []
    for pattern in rules.opens:
        for m in re.finditer(pattern, code, re.M):
            spots.append((m.start(), m.group(1).strip()))
    taken = []
    for at, text in sorted(spots):
        taken.append(bisect.bisect_right(starts, at))
        opens += _use_paths(text) if language == "rust" else [text]
    refs = []
    skip_lines = set(taken)
    defined = set(found)
    for m in re.finditer(rf"{IDENT}(?:(?:\.|::|\\|->){IDENT})*[?!]?", bare):
        name = m.group().rstrip("?!") if language != "ruby" else m.group()
        line, column = place(m.start())
        if m.start() in defined or line in skip_lines or name in _WORDS:
            continue
        refs.append({"name": name.replace("->", "."), "line": line, "column": column})
    return {"symbols": symbols, "refs": refs, "opens": opens, "diagnostics": []}


def _use_paths(text: str) -> list[str]:
    """The paths of an import whose braces list several."""
    m = re.match(r"^([^{]*)\{(.*)\}$", text.strip(), re.S)
    if not m:
        return [re.sub(r"\s+as\s+\w+$", "", text.strip())]
    parts, depth, at = [], 0, 0
    for i, c in enumerate(m.group(2) + ","):
        depth += (c == "{") - (c == "}")
        if c == "," and depth == 0:
            parts.append((m.group(2) + ",")[at:i].strip())
            at = i + 1
    return [p for part in parts if part for p in _use_paths(m.group(1).strip() + part)]
