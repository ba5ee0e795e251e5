"""Symbols of JavaScript, TypeScript and Java files, by expressions over whole texts.

A text is lexed by one pattern of comments, strings, templates and regular expressions, whose first alternative at a place wins, so a quote in a
comment opens no string and the other way round, over any number of lines. mask() blanks those tokens (line ends, module names and the code of a
template's substitutions stay). Heads of declarations and braces are then found by a second pattern, with their parameters over as many lines
as they take, and become rows with their place in the text; running sums of braces give each one's depth, and the last brace that opened
its level is the block that it stands in, which is how methods find their class. It is one chain of windows over a file's rows, without a join.

All loops of the patterns are possessive: linear time, and no recursion in the engine, whatever a text holds. Parentheses, angles and braces
within heads may be nested three deep, substitutions in templates two deep. What goes beyond that, and a regular expression after a closing parenthesis, is taken for plain code.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

#: Words before a parenthesis that are no calls.
KEYWORDS = ["if", "for", "while", "switch", "catch", "return", "function", "super", "new", "typeof", "await", "constructor", "do", "else", "try", "throw", "synchronized", "import", "this"]
WHERE = ("path", "rel_path", "language")
NAME = r"[A-Za-z_$][\w$]*+"


def _nested(opens: str, closes: str, deep: int) -> str:
    """Text between two marks, with `deep` levels of the same marks in it."""
    inside = rf"[^{opens}{closes}]*+"
    for _ in range(deep):
        inside = rf"[^{opens}{closes}]*+(?:{opens}{inside}{closes}[^{opens}{closes}]*+)*+"
    return inside


PARENS, ANGLES, BRACES = _nested(r"\(", r"\)", 3), _nested("<", ">", 3), _nested(r"\{", r"\}", 2)
COMMENT = r"//[^\n]*+|/\*(?:[^*]++|\*(?!/))*+(?:\*/|\z)"
STRING = r'"[^"\\\n]*+(?:\\[\s\S][^"\\\n]*+)*+"|' r"'[^'\\\n]*+(?:\\[\s\S][^'\\\n]*+)*+'"
_PLAIN = r"`[^`\\]*+(?:\\[\s\S][^`\\]*+)*+`"
_SUBSTITUTION = rf"\$\{{(?:[^{{}}`]++|{_PLAIN}|\{{{BRACES}\}})*+\}}"
TEMPLATE = rf"`(?:[^`\\$]++|\\[\s\S]|{_SUBSTITUTION}|\$)*+`"
REGEX = r"(?<=[(,=:\[!&|?{};\n])[ \t]*+/(?![/*])(?:[^/\\\[\n]++|\\.|\[(?:[^\]\\\n]++|\\.)*+\])++/[a-z]*+"
TEXT_BLOCK = r'"""(?:[^"\\]++|\\[\s\S]|"(?!""))*+"""'
TOKENS = {"java": f"{COMMENT}|{TEXT_BLOCK}|{STRING}", "script": f"{COMMENT}|{STRING}|{TEMPLATE}|{REGEX}"}
#: A string that holds no more than a module's name keeps it.
MODULE = r"^[\"'][\w@./~:+*#-]*+[\"']$"

_DECORATORS = rf"(?:@[\w.$]++(?:\({PARENS}\))?\s*+)*+"
_TYPE = rf"(?:\s*+:\s*+(?:[^;{{}}=<>()\n]++|=>|<{ANGLES}>|\({PARENS}\)|\{{{BRACES}\}}(?=\s*+[\[|&{{]))*+)?"
_GENERIC = rf"(?:\s*+<{ANGLES}>)?"
#: Where a declaration can begin: at a word, behind nothing but an indent (of 200 at most) and what ends the declaration before.
_START = r"(?=[A-Za-z_$@*<])(?<![\w$])(?<=(?:[;{},)\n]|\A)[ \t]{0,200})"
SCRIPT = {
    "import": rf"""{_START}import\b\s*+(?:[^;'"()]*?\bfrom\s*+)?['"][^'"\n]++['"]""",
    "class": rf"(?<![\w$.])(?:class|interface)\s++(?:extends\b)?(?:{NAME})?{_GENERIC}[^{{}};()=]*+(?:\({PARENS}\)[^{{}};()=]*+)?\{{",
    "function": rf"(?<![\w$.])function\s++{NAME}{_GENERIC}\s*+\({PARENS}\)",
    "arrow": rf"(?<![\w$.])(?:const|let|var)\s++{NAME}\s*+(?::(?:[^=;]|=>)*?)?=\s*+(?:async\b\s*+)?(?:<{ANGLES}>\s*+)?\({PARENS}\)\s*+(?::(?:[^=;{{]|\{{{BRACES}\}})*?)?=>",
    "abstract": rf"(?<![\w$.])abstract\s++(?:(?:public|private|protected|readonly|override|get|set)\s++)*+{NAME}\??{_GENERIC}\s*+\({PARENS}\)",
    "method": rf"{_START}{_DECORATORS}(?:(?:public|private|protected|static|async|readonly|override|get|set)\s++(?!\())*+\*?\s*+(?!(?:if|for|while|switch|catch|return|function|super|new|typeof|await|do|else|try|throw|import|with)\b){NAME}{_GENERIC}\s*+\({PARENS}\){_TYPE}\s*+\{{",
}
_MODS = r"(?:(?:public|private|protected|static|final|abstract|synchronized|default|native|strictfp|sealed)\s++)*+"
_NOT = r"(?!(?:if|for|while|switch|catch|return|throw|new|else|do|try|case|assert|yield|package|import|super|this|instanceof|class|interface|enum|record|synchronized)\b)"
_THROWS = r"\s*+(?:throws\s++[\w.,\s]++)?"
JAVA = {
    "marker": rf"@interface\s++{NAME}\s*+\{{",
    "import": _START + r"import\s++(?:static\s++)?\w++(?:\.\w++)*+(?:\.\*)?\s*+;",
    "class": rf"(?<![\w$.@])(?:class|interface|enum)\s++{NAME}[^{{}};()=]*+\{{",
    "method": rf"{_START}{_DECORATORS}{_MODS}(?:<{ANGLES}>\s*+)?{_NOT}[\w$.]++(?:\s*+<{ANGLES}>)?(?:\s*+\[\s*+\])*+\s++{_NOT}{NAME}\s*+\({PARENS}\)(?:\s*+\[\s*+\])*+{_THROWS}[{{;]",
    "constructor": rf"{_START}{_DECORATORS}{_MODS}(?:<{ANGLES}>\s*+)?{_NOT}{NAME}\s*+\({PARENS}\){_THROWS}\{{",
}


def cut(text: Column, pattern: str) -> Column:
    """Array of (gap, found): the text before each match and the match, at last the rest with a null."""
    return F.arrays_zip(F.split(text, F.lit(pattern)).alias("gap"), F.regexp_extract_all(text, F.lit(pattern), F.lit(0)).alias("found"))


def mask(text: Column, language: str) -> Column:
    """The text without what is no code; every line stays a line."""

    def blank(token: Column) -> Column:
        kept = F.regexp_replace(token, rf"({_SUBSTITUTION})|[^\n]", "$1")
        quiet = F.when(F.regexp_like(token, F.lit(MODULE)), token).when(F.regexp_like(token, F.lit("^[\"']")), F.concat(F.lit('""'), F.regexp_replace(token, r"[^\n]++", "")))
        return quiet.when(token.startswith("`"), F.concat(F.lit('""'), kept)).otherwise(F.concat(F.lit(" "), F.regexp_replace(token, r"[^\n]++", "")))

    pieces = F.transform(F.array(cut(text, TOKENS[language])), lambda xs: F.array_join(F.transform(xs, lambda x: F.concat(x["gap"], F.coalesce(blank(x["found"]), F.lit("")))), ""))
    return F.element_at(pieces, 1)


def flat(text: Column) -> Column:
    """Without what stands in brackets, so that commas are those between the parts."""
    for _ in range(4):
        text = F.regexp_replace(text, r"\([^()]*+\)|\{[^{}]*+\}|\[[^\[\]]*+\]|<[^<>]*+>", "")
    return text


def _parts(text: Column, pattern: str) -> Column:
    """Trimmed, non-empty parts between commas, each reduced to the pattern's group."""
    return F.filter(F.transform(F.split(text, ","), lambda x: F.regexp_extract(x, pattern, 1)), lambda x: x != "")


def _parameters(inside: Column, language: str) -> Column:
    """Names of parameters; of scripts those that are plain names, in TypeScript also with a type or a default; in Java no open-ended one."""
    if language == "java":
        closed = F.filter(F.split(flat(inside), ","), lambda x: ~x.contains("..."))
        return F.filter(F.transform(closed, lambda x: F.regexp_extract(x, r"([A-Za-z_$][\w$]*)\s*$", 1)), lambda x: x != "")
    typed = r"^\s*(?:@[\w.$]+\s*)*(?:(?:public|private|protected|readonly|override)\s+)*(?!this\b)([A-Za-z_$][\w$]*)\s*(?:\?\s*)?(?:[:=].*)?$"
    return F.when(F.col("language") == "javascript", _parts(flat(inside), rf"^\s*({NAME})\s*$")).otherwise(_parts(flat(F.regexp_replace(inside, r"\s+", " ")), typed))


def _bases(head: Column, language: str) -> Column:
    """What a class extends and implements, as far as it is plain names (scripts: a base that is extended may have type arguments)."""
    of = lambda text: _parts(text, rf"^\s*({NAME})\s*$")
    marked = F.regexp_replace(head, rf"<{ANGLES}>", "<")
    parent = F.regexp_extract(marked, r"\bextends ((?:(?!implements\b).)*?) ?(?:implements\b.*)?\{$", 1)
    return F.concat(of(F.regexp_replace(parent, "<", "") if language == "script" else parent), of(F.regexp_extract(marked, r"\bimplements (.*?) ?\{$", 1)))


def _called(code: Column, line: Column, language: str) -> Column:
    """Array of (line, name) of what is called in a stretch of code."""
    pattern = rf"(?<![\w$@])((?:\.\s*+)?(?:(?:new\b|function\b\s*+\*?)\s*+)?{NAME})\s*+(?:<[\w$.,\s\[\]|]*+>)?(?:\?\.)?\s*+\("

    def wanted(call: Column) -> Column:
        return ~F.regexp_like(call, F.lit(rf"\bnew\s|^function\b.|^(?:{'|'.join(KEYWORDS)})$" + (r"|(?<![\w$])[A-Z][\w$]*$" if language == "script" else "")))

    def of_line(text: Column, k: Column) -> Column:
        names = F.filter(F.regexp_extract_all(text, F.lit(pattern), F.lit(1)), wanted)
        return F.transform(names, lambda call: F.struct((line + k).cast("int").alias("line"), F.regexp_extract(call, rf"({NAME})$", 1).alias("name")))

    return F.flatten(F.transform(F.split(code, "\n"), of_line))


def _events(files: DataFrame, language: str) -> DataFrame:
    """Heads and braces in the order of the text: where, at, gap (the text before), gap_line, line, head, inside (its parentheses), kind, name, own, block, in_class and listing.

    own: the event's number if it ends with an opening brace; block: that of the innermost brace open there, in_class the class that opened it; listing: whether it
    is an interface's, an annotation's or an enum's, whose members look like calls.
    """
    rules = JAVA if language == "java" else SCRIPT
    pattern = "|".join([*rules.values(), r"[{}]"])
    rows = files.select(*WHERE, mask(F.col("text"), language).alias("code")).select(*WHERE, F.posexplode(cut(F.col("code"), pattern)).alias("at", "x")).select(*WHERE, "at", "x.gap", "x.found", F.col("x.found").alias("head"))
    kind = F.when(F.col("found").isin("{", "}") | F.col("found").isNull(), None)
    for k in ("import", "marker", "class", "function", "arrow", "abstract", "constructor", "method"):
        if k in rules:
            kind = kind.when(F.regexp_like("found", F.lit(rf"\A(?:{rules[k]})\z")), k)
    bare = F.regexp_replace("head", rf"\A{_DECORATORS}", "")
    inside = F.regexp_extract(bare, rf"\(({PARENS})\)(?:[^()]|\({PARENS}\))*+$", 1)
    rows = rows.withColumns({"kind": kind, "inside": F.when(kind.isin("function", "arrow", "abstract", "constructor", "method"), inside)})
    before = F.regexp_replace(F.regexp_replace(bare, rf"\({PARENS}\)(?:[^()]|\({PARENS}\))*+$", ""), rf"{_GENERIC}\s*$", "")
    name = F.when(F.col("kind") == "class", F.regexp_extract("head", rf"^(?:class|interface|enum)\s+(?!extends\b|implements\b)({NAME})", 1))
    name = name.when(F.col("kind") == "arrow", F.regexp_extract("head", rf"^\w+\s+({NAME})", 1)).otherwise(F.regexp_extract(before, rf"({NAME})\s*\??\s*$", 1))
    lines = lambda c: F.length(F.regexp_replace(F.coalesce(F.col(c), F.lit("")), r"[^\n]++", ""))
    rows = rows.withColumns({"name": F.when(F.col("kind").isNotNull(), name), "step": F.when(F.col("found").endswith("{"), 1).when(F.col("found") == "}", -1).otherwise(0), "tall": lines("gap") + lines("found")})
    earlier = Window.partitionBy("path").orderBy("at").rowsBetween(Window.unboundedPreceding, -1)
    rows = rows.withColumns({"gap_line": (F.coalesce(F.sum("tall").over(earlier), F.lit(0)) + 1).cast("int"), "depth": F.coalesce(F.sum("step").over(earlier), F.lit(0))})
    rows = rows.withColumn("line", (F.col("gap_line") + lines("gap")).cast("int"))
    # A brace that opens stands at its own level too, for what is inside.
    rows = rows.withColumn("opens", F.explode(F.when(F.col("step") == 1, F.array(F.lit(False), F.lit(True))).otherwise(F.array(F.lit(False))))).withColumn("level", F.col("depth") + F.when(F.col("opens"), 1).otherwise(0))
    opener = F.when(F.col("opens"), F.struct("at", F.when(F.col("kind") == "class", F.col("name")).alias("name"), F.regexp_like("head", F.lit(r"^(?:@?interface|enum)\b")).alias("listing")))
    level = Window.partitionBy("path", "level").orderBy("at").rowsBetween(Window.unboundedPreceding, Window.currentRow)
    rows = rows.withColumn("outer", F.last(opener, True).over(level)).filter("not opens")
    return rows.select(*WHERE, "at", "gap", "gap_line", "line", "head", "inside", "kind", "name", F.when(F.col("step") == 1, F.col("at")).alias("own"), F.col("outer.at").alias("block"), F.col("outer.name").alias("in_class"), F.coalesce("outer.listing", F.lit(False)).alias("listing"))


def symbols(files: DataFrame, language: str) -> DataFrame:
    """(where, kind, name, line, params, bases, methods, module, names, once) of Java files, or of JavaScript and TypeScript ones (language "script").

    Of rows that agree in kind and once (not null), the first by line is the symbol.
    """
    rows = _events(files, language)
    head = F.regexp_replace("head", r"\s+", " ")
    member = F.col("kind").isin("method", "constructor") & F.col("in_class").isNotNull() & (F.col("name") != "")
    member = member & ((F.col("kind") != "constructor") | (F.col("name") == F.col("in_class")))
    about = Window.partitionBy("path", F.when(F.col("kind") == "class", F.col("own")).otherwise(F.col("block")))
    rows = rows.withColumn("members", F.array_sort(F.collect_list(F.when(member, F.struct("at", "name"))).over(about))).withColumn("flat_head", head)
    none = F.array().cast("array<string>")
    plain = F.startswith("head", F.lit("class"))

    def row(kind: str, name: Column = F.lit(None), line: Column = F.col("line"), **more: Column) -> Column:
        kinds = {"params": "array<string>", "bases": "array<string>", "methods": "array<string>", "module": "string", "names": "array<string>", "once": "string"}
        return F.struct(F.lit(kind).alias("kind"), name.cast("string").alias("name"), line.cast("int").alias("line"), *(more.get(k, F.lit(None)).cast(t).alias(k) for k, t in kinds.items()))

    is_function = F.col("kind").isin("function", "arrow", "abstract", "method") | (F.col("kind") == "constructor") & (F.col("name") == F.col("in_class"))
    function = row("function", F.col("name"), params=_parameters(F.col("inside"), language), once=F.col("name") if language == "script" else F.lit(None))
    named = F.coalesce((F.col("kind") == "class") & (F.col("name") != ""), F.lit(False))
    parents = F.when(plain, _bases(F.col("flat_head"), language)).otherwise(none)
    found = F.regexp_replace("flat_head", r"^import (?:static )?", "")
    if language == "java":
        whole = F.regexp_extract(found, r"^(\w+(?:\.\w+)*(?:\.\*)?)", 1)
        module = F.when(whole.contains("."), F.regexp_replace(whole, r"\.[^.]*$", "")).otherwise(whole)
        names = F.array(F.element_at(F.split(whole, r"\."), -1))
    else:
        module = F.regexp_extract("flat_head", r"""['"]([^'"]+)['"]$""", 1)
        names = _parts(F.regexp_replace(F.regexp_extract("flat_head", r"^import (.*?)\s*\bfrom\s*['\"]", 1), r"[{}]|\*\s*as\b|\btype\b(?=\s*[\w${*])", " "), rf"^\s*({NAME})")
    calls = F.concat(_called(F.when(F.col("listing"), "").otherwise(F.col("gap")), F.col("gap_line"), language), _called(F.coalesce("inside", F.lit("")), F.col("line"), language))
    parts = [
        F.when(F.coalesce(is_function & (F.col("name") != ""), F.lit(False)), F.array(function)),
        F.when(named, F.array(row("class", F.col("name"), bases=none, methods=F.when(plain, F.col("members.name")).otherwise(none)))),
        F.when(named & (F.size(parents) > 0), F.array(row("inheritance", F.col("name"), bases=parents))),
        F.when(F.col("kind") == "import", F.array(row("import", module=module, names=names))),
        F.transform(calls, lambda c: row("call", c["name"], c["line"], once=c["name"])),
    ]
    return rows.select(*WHERE, F.explode(F.flatten(F.filter(F.array(*parts), lambda x: x.isNotNull()))).alias("s")).select(*WHERE, "s.*")
