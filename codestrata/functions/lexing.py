"""Kernels that turn one C or C++ text into rows.  Plain Python on one file at a time, iterative throughout.

They run inside a single Arrow-batched stage (see ``operators.code``); everything after them is relational.
"""

from __future__ import annotations

import re
from typing import NamedTuple

MAX_LEX_BYTES = 1 << 20

# -- includes --------------------------------------------------------------------------------------------------------

_BLANKED = re.compile(r'R"([^()\\\s]{0,16})\(.*?\)\1"|"(?:[^"\\\n]|\\.)*"|\'(?:[^\'\\\n]|\\.)*\'|//[^\n]*|/\*.*?(?:\*/|\Z)', re.S)
_INCLUDE = re.compile(r'[ \t]*#include[ \t]*(?:"([^"\n]*)"|<([^>\n]*)>|([A-Za-z_]\w*))')
_DIRECTIVE = re.compile(r"[ \t]*#[ \t]*(ifndef|ifdef|if|endif|define)\b[ \t]*(\w*)")


def scan_includes(src: str) -> tuple[list[tuple], list[tuple]]:
    """Directives (kind, token, line, conditional) and diagnostics (kind, raw, line)."""
    src = src.removeprefix("\ufeff")
    # physical lines, each logical line with the number of its first one
    logical, buffer, first = [], "", 1
    for n, line in enumerate(src.split("\n"), 1):
        cut = line.rstrip("\r")
        if cut.endswith("\\"):
            if not buffer:
                first = n
            buffer += cut[:-1]
            if not buffer:
                buffer = " "
            continue
        logical.append((first if buffer else n, buffer + line))
        buffer = ""
    if buffer:
        logical.append((first, buffer))
    text = "\n".join(t for _, t in logical)

    def blank(m: re.Match) -> str:
        s = m.group()
        if s[0] in "\"'":
            return s
        return re.sub(r"[^\n]", " ", s)

    # raw strings may span logical lines; what is blanked keeps its newlines
    lines = _BLANKED.sub(blank, text).split("\n")
    real = [i for i, t in enumerate(lines) if t.strip()]
    guard = None
    if len(real) > 1:
        a, b = _DIRECTIVE.match(lines[real[0]]), _DIRECTIVE.match(lines[real[1]])
        if a and b and a[1] == "ifndef" and b[1] == "define" and a[2] == b[2] and re.fullmatch(r"[A-Z0-9_]+", a[2] or ""):
            guard = real[0]
    depth, found, odd = 0, [], []
    for i, t in enumerate(lines):
        d = _DIRECTIVE.match(t)
        if d and d[1] in ("if", "ifdef", "ifndef") and i != guard:
            depth += 1
        elif d and d[1] == "endif":
            depth = max(0, depth - 1)
        m = _INCLUDE.match(t)
        if m is None:
            continue
        line = logical[i][0]
        if m[3]:
            odd.append(("MacroInclude", m[3], line))
        else:
            found.append(("quote" if m[1] is not None else "angle", m[1] if m[1] is not None else m[2], line, depth > 0))
    return found, odd


# -- tokens ----------------------------------------------------------------------------------------------------------


class Tok(NamedTuple):
    sym: str
    line: int
    raw: str
    off: int

    @property
    def text(self) -> str:
        return self.raw or self.sym


KEYWORDS = frozenset(
    """and and_eq asm alignas alignof auto bitor bitand break bool catch case char32_t char16_t char8_t char compl class concept
    constinit constexpr consteval const_cast const continue co_yield co_return co_await default decltype delete double dynamic_cast do
    enum else extern export explicit friend for float false final goto inline int if long mutable noexcept namespace nullptr not_eq not new
    override operator or_eq or public protected private return reinterpret_cast requires register switch struct static_cast static_assert
    static sizeof signed short typename typeid typedef try true throw this thread_local template unsigned union using volatile void virtual
    while wchar_t xor_eq xor""".split()
)
_TOKEN = re.compile(
    r"""(?P<nl>\n)|(?P<ws>[^\S\n]+)|(?P<com>//[^\n]*|/\*.*?(?:\*/|\Z))
    |(?P<rawstr>(?:u8|[LuU])?R"(?P<d>[^()\\\s]{0,16})\(.*?(?:\)(?P=d)"|\Z))
    |(?P<str>"(?:\\.|[^"\\])*(?:"|\Z)|'(?:\\.|[^'\\])*(?:'|\Z))
    |(?P<num>\.?\d(?:[eEpP][+-]|[\w.'])*)
    |(?P<id>[A-Za-z_]\w*)
    |(?P<op><=>|->\*|\.\.\.|<<=|>>=|[-+*/%&|^<>=!]=|::|->|\+\+|--|<<|>>|&&|\|\||\.\*)
    |(?P<one>.)""",
    re.X | re.S | re.A,
)
_DEAD = re.compile(r"#[ \t]*if(?!\w)[ \t]*(?:false|0(?=[\s/]|\Z))", re.A)
_COND = re.compile(r"#[ \t]*(if|endif)")


def _after_dead(src: str, at: int) -> int:
    depth = 0
    while at < len(src):
        m = _COND.match(src, at)
        if m:
            depth += 1 if m[1] == "if" else -1
        at = src.find("\n", at) + 1 or len(src)
        if depth == 0:
            break
    return at


def lex(src: str, keep_calls: bool = False) -> list[Tok]:
    """Normalised tokens: literals ``lit``, identifiers ``id`` (their spelling kept aside); dead ``#if 0`` blocks go."""
    if len(src.encode("utf-8", "surrogateescape")) > MAX_LEX_BYTES:
        return []
    out, at, line, fresh = [], 0, 1, True
    while at < len(src):
        m = _TOKEN.match(src, at)
        kind, text = m.lastgroup, m.group()
        if kind == "d":
            kind = "rawstr"
        if fresh and text == "#" and _DEAD.match(src, at):
            end = _after_dead(src, at)
            line += src.count("\n", at, end)
            at = end
            continue
        if kind == "nl":
            fresh = True
            line += 1
        elif kind in ("ws", "com"):
            line += text.count("\n")
        else:
            fresh = False
            if kind in ("rawstr", "str", "num"):
                out.append(Tok("lit", line, text, at))
                line += text.count("\n")
            elif kind == "id" and text not in KEYWORDS:
                called = keep_calls and (re.match(r"[ \t\r\n]*\(", src[m.end() :][:256]) or (out and out[-1].sym == "case"))
                out.append(Tok(text, line, "", at) if called else Tok("id", line, text, at))
            else:
                out.append(Tok(text, line, "", at))
        at = m.end()
    return out


def strip_directives(toks: list[Tok]) -> list[Tok]:
    """Without preprocessor lines; of each conditional chain only the longest branch stays, the first of equals."""
    frames: list[list[list[Tok]]] = [[[]]]  # branches of each open chain; the last branch collects

    def close() -> None:
        branches = frames.pop()
        frames[-1][-1].extend(max(branches, key=len))

    i, n = 0, len(toks)
    while i < n:
        if toks[i].sym != "#" or (i and toks[i - 1].line == toks[i].line):
            frames[-1][-1].append(toks[i])
            i += 1
            continue
        word = toks[i + 1].text if i + 1 < n and toks[i + 1].line == toks[i].line else ""
        if word in ("if", "ifdef", "ifndef"):
            frames.append([[]])
        elif word in ("elif", "else") and len(frames) > 1:
            frames[-1].append([])
        elif word == "endif" and len(frames) > 1:
            close()
        line = toks[i].line
        while i < n and (toks[i].line == line or toks[i - 1].sym == "\\"):
            line = toks[i].line
            i += 1
    while len(frames) > 1:
        close()
    return frames[0][0]


# -- functions -------------------------------------------------------------------------------------------------------


class Function(NamedTuple):
    name: str
    params: str
    arity: int
    start: int
    end: int
    body: tuple[int, int]
    parens: tuple[int, int]


PAIRS = {"(": ")", "[": "]", "{": "}"}


def matches(toks: list[Tok]) -> dict[int, int]:
    """Partner of every opening bracket, each kind by itself."""
    partner: dict[int, int] = {}
    for opening, closing in PAIRS.items():
        stack: list[int] = []
        for i, t in enumerate(toks):
            if t.sym == opening:
                stack.append(i)
            elif t.sym == closing and stack:
                partner[stack.pop()] = i
    return partner


def _called_name(toks: list[Tok], paren: int) -> tuple[str, int, int]:
    """(name, line, opening parenthesis of the parameters) left of ``paren``; an empty name if there is none."""
    sym = lambda k: toks[k].sym if 0 <= k < len(toks) else ""
    if sym(paren - 1) == "operator" and sym(paren + 1) == ")" and sym(paren + 2) == "(":
        return "operator()", toks[paren - 1].line, paren + 2
    k = paren - 1
    if sym(k) == "id":
        line, parts = toks[k].line, [toks[k].text]
        if sym(k - 1) == "~":
            parts[0] = "~" + parts[0]
            k -= 1
        while sym(k - 1) == "::" and sym(k - 2) == "id":
            parts.append(toks[k - 2].text)
            k -= 2
        return "::".join(reversed(parts)), line, paren
    for back in (1, 2):
        if sym(k - back) == "operator" and k - back >= 0:
            return "operator" + "".join(t.text for t in toks[k - back + 1 : paren]), toks[k - back].line, paren
    return "", 0, paren


def _arity(toks: list[Tok], a: int, b: int) -> int:
    inner = [t.sym for t in toks[a + 1 : b]]
    if not inner or inner == ["void"]:
        return 0
    depth = angle = commas = 0
    for s in inner:
        if s in "([{" and len(s) == 1:
            depth += 1
        elif s in ")]}" and len(s) == 1:
            depth -= 1
        elif depth == 0:
            if s == "<":
                angle += 1
            elif s in (">", ">>"):
                angle = max(0, angle - len(s))
            elif s == "," and not angle:
                commas += 1
    return commas + 1


def _body(toks: list[Tok], k: int, partner: dict[int, int]) -> int | None:
    """The body's ``{`` after the parameters: qualifiers, a trailing return type or an initialiser list may precede it."""
    mode = "qualifiers"
    while k < len(toks):
        s = toks[k].sym
        if mode == "initialisers":
            if s in ("(", "{") and toks[k - 1].sym in ("id", ">"):
                if k not in partner:
                    return None
                k = partner[k]
            elif s == "{":
                return k
            elif s == ";":
                return None
        elif s == "{":
            return k
        elif mode == "return":
            if s in (";", "=", "}"):
                return None
            if s == "(":
                if k not in partner:
                    return None
                k = partner[k]
        elif s == "->":
            mode = "return"
        elif s == ":":
            mode = "initialisers"
        elif s in ("noexcept", "throw") and k + 1 < len(toks) and toks[k + 1].sym == "(":
            if k + 1 not in partner:
                return None
            k = partner[k + 1]
        elif s not in ("const", "final", "mutable", "noexcept", "override", "&", "&&"):
            return None
        k += 1
    return None


def _scope(toks: list[Tok], k: int) -> tuple[int, str] | None:
    """The ``{`` and name of a namespace or class whose keyword is at ``k``."""
    name, bases = "", False
    for j in range(k + 1, len(toks)):
        s = toks[j].sym
        if s == "{":
            return j, name
        if s in (";", "(", ")", "=", "}") or (not bases and s in ("<", ">", ",")):
            return None
        if s == ":":
            bases = True
        elif s == "id" and not bases:
            name = f"{name}::{toks[j].text}" if toks[j - 1].sym == "::" else toks[j].text
    return None


def functions(toks: list[Tok]) -> list[Function]:
    """Function definitions; what is nested in a body belongs to the outer function."""
    partner, out, scopes, depth, i = matches(toks), [], [], 0, 0
    while i < len(toks):
        s = toks[i].sym
        if s == "(":
            name, line, parens = _called_name(toks, i)
            close = partner.get(parens) if name else None
            if close is None:
                i += 1
                continue
            start = _body(toks, close + 1, partner)
            end = partner.get(start) if start is not None else None
            if end is None:
                i = close + 1
                continue
            prefix = "".join(f"{n}::" for n, _ in scopes if n)
            out.append(Function(prefix + name, "".join(t.text for t in toks[parens + 1 : close]), _arity(toks, parens, close), line, toks[end].line, (start, end), (parens, close)))
            i = end + 1
            continue
        if s in ("class", "namespace", "struct", "union") and (at := _scope(toks, i)):
            depth += 1
            scopes.append((at[1], depth))
            i = at[0] + 1
            continue
        if s == "{":
            depth += 1
        elif s == "}":
            depth -= 1
            while scopes and scopes[-1][1] > depth:
                scopes.pop()
        i += 1
    return out


class Score(NamedTuple):
    score: int
    structural: int
    nesting: int
    loc: int


def cognitive(toks: list[Tok], body: tuple[int, int]) -> Score:
    """Cognitive score of a body: control flow weighted by nesting, runs of a logical operator once."""
    own = toks[body[0] + 1 : body[1]]
    score = count = level = deepest = parens = hanging = 0
    frames: list[tuple[bool, bool]] = []
    runs = [""]
    control = is_do = header_next = in_header = after_else = elseif = do_tail = silent = maybe_lambda = False
    header_at = 0
    previous: Tok | None = None
    for t in own:
        s = t.sym
        if after_else:
            after_else = False
            if s == "if":
                elseif = True
            else:
                control = True
        if control and s != "{":  # a body without braces
            level += 1
            deepest = max(deepest, level)
            hanging += 1
            control = is_do = False
        gained = None
        if s in ("&&", "||", "and", "or"):
            glued = s in ("&&", "||") and previous is not None and t.off == previous.off + len(previous.text) and (previous.text[-1].isalnum() or previous.text[-1] in "_>")
            op = {"and": "&&", "or": "||"}.get(s, s)
            if not glued and runs[parens] != op:
                gained, runs[parens] = 1, op
        elif s in ("case", "default"):
            pass
        elif s == "while" and (do_tail or silent):
            do_tail, silent = False, True
        elif s == "if" and elseif:
            elseif, header_next = False, True
        elif s in ("catch", "for", "if", "switch", "while"):
            gained, header_next = 1 + level, True
        elif s == "do":
            gained, control, is_do = 1 + level, True, True
        elif s == "else":
            gained, after_else = 1, True
        elif s in ("co_await", "goto"):
            gained = 1
        elif s == "?":
            gained = 1 + level
        elif s == "!":
            runs[parens] = ""
        elif s == "(":
            parens += 1
            runs[parens:] = [""]
            if header_next:
                header_next, in_header, header_at = False, True, parens - 1
            # the run at this depth starts anew
        elif s == ")":
            parens = max(0, parens - 1)
            del runs[parens + 1 :]
            if in_header and parens == header_at:
                in_header = False
                if silent:
                    silent = False
                else:
                    control = True
        elif s == "[":
            maybe_lambda = True
        elif s == "=":
            maybe_lambda = False
        elif s == "{":
            nests = control or maybe_lambda
            frames.append((nests, control and is_do))
            if nests:
                level += 1
                deepest = max(deepest, level)
            if control:
                control = is_do = False
            else:
                maybe_lambda = False
        elif s == "}":
            if frames:
                nests, was_do = frames.pop()
                if nests:
                    level = max(0, level - 1)
                do_tail = do_tail or was_do
        elif s == ";" and parens == 0:
            maybe_lambda = False
            level, hanging = max(0, level - hanging), 0
        if gained:
            score += gained
            count += 1
        previous = t
    return Score(score, count, deepest, sum(1 for a, b in zip([None, *own], own) if a is None or a.line != b.line))


def file_functions(src: str) -> list[tuple[Function, Score]]:
    toks = strip_directives(lex(src))
    return [(f, cognitive(toks, f.body)) for f in functions(toks)]


def unclosed(src: str) -> bool:
    toks = strip_directives(lex(src))
    return sum((t.sym == "{") - (t.sym == "}") for t in toks) > 0


# -- fragments -------------------------------------------------------------------------------------------------------

_SKELETON = re.compile(r"break;$|default:$|switch ?\(|case .*:$|(?:case |default:).*:.* break;|default:.* break;")


def norm_lines(src_lines: list[str], first: int, last: int) -> list[str]:
    """Lines with blanks collapsed, without empty ones and switch skeletons."""
    out = []
    for raw in src_lines[first - 1 : last]:
        n = re.sub(r"[ \t\r\f\v]+", " ", raw).strip(" ")
        if n and not _SKELETON.match(n):
            out.append(n)
    return out


def fragments(src: str, smallest: int = 30, largest: int = 600) -> list[dict]:
    """Blocks of function bodies with ``smallest`` to ``largest`` tokens; other braces are descended into."""
    toks = lex(src, keep_calls=True)
    partner = {k: v for k, v in matches(toks).items() if toks[k].sym == "{"}
    lines, out, i = src.split("\n"), [], 0
    while i < len(toks):
        j = partner.get(i)
        if j is not None and i and toks[i - 1].sym == ")" and smallest <= j - i - 1 <= largest:
            own = toks[i + 1 : j]
            seq, bag, parens, statements = [t.sym for t in own], {}, 0, 0
            for s in seq:
                bag[s] = bag.get(s, 0) + 1
                if s == "(":
                    parens += 1
                elif s == ")":
                    parens = max(0, parens - 1)
                elif s == ";" and not parens:
                    statements += 1
            norm = norm_lines(lines, own[0].line, own[-1].line)
            grams = set(zip(seq, seq[1:], seq[2:]))
            out.append({"start_line": own[0].line, "end_line": own[-1].line, "token_count": len(own), "stmts": statements, "bag": bag, "seq": seq, "raw_seq": [t.text for t in own], "norm_lines": sorted(set(norm)), "norm_line_seq": [n for n in norm if len(n.encode()) >= 4], "diversity": len(grams) / (len(seq) - 2) if len(seq) > 2 else 1.0})
            i = j + 1
        else:
            i += 1
    return out


# -- structs and flags -----------------------------------------------------------------------------------------------

_STRUCT = re.compile(r"\b(?:class|struct)\s+((?:[A-Za-z_]\w*::)*[A-Za-z_]\w*)\s*(?:final\s*)?(?::[^{;]*)?\{")
_BOOL = re.compile(r"\s*(?:(?:const|mutable)\s+)?bool\s+([A-Za-z_]\w*)\s*(?::\s*\d+)?(?:\s*=\s*[^;]+|\s*\{[^{};]*\})?;\s*(?://.*)?")
_QUIET = re.compile(r"\"(?:\\.|[^\"\\])*(?:\"|\Z)|'(?:\\.|[^'\\])*(?:'|\Z)|//[^\n]*|/\*.*?(?:\*/|\Z)", re.S)


def _bodies(src: str):
    quiet = _QUIET.sub(lambda m: re.sub(r"[{}]", " ", m.group()), src)
    for m in _STRUCT.finditer(src):
        depth, start = 0, None
        for b in re.compile(r"[{}]").finditer(quiet, m.start()):
            if b.group() == "{":
                start = b.end() if start is None else start
                depth += 1
            else:
                depth -= 1
                if depth == 0 and start is not None:
                    yield m[1], start, b.start(), quiet
                    break


def struct_names(src: str) -> list[str]:
    return sorted({name for name, *_ in _bodies(src)})


def bool_fields(src: str) -> list[tuple[str, str, int]]:
    """(struct, field, line) of plain boolean members at the top of a struct."""
    out = []
    for name, a, b, quiet in _bodies(src):
        depth, at, line = 0, a, src.count("\n", 0, a) + 1
        for text in src[a:b].split("\n"):
            m = _BOOL.fullmatch(text)
            code = text.split("//", 1)[0]
            if m and depth == 0 and "(" not in code and ")" not in code:
                out.append((name, m[1], line))
            q = quiet[at : at + len(text)]
            depth = max(0, depth + q.count("{") - q.count("}"))
            at += len(text) + 1
            line += 1
    return out


def flag_arguments(src: str) -> list[tuple[str, int, str]]:
    """(rule, line, message) of boolean flag parameters and calls with several boolean literals."""
    from codestrata.functions.classify import FLAG_PREFIX

    toks = lex(src)
    found, out, seen = functions(toks), [], set()
    flag = re.compile("(?i:" + "|".join(FLAG_PREFIX) + r")(_|[A-Z]|$)")
    for f in found:
        names, depth, current = [], 0, []
        for t in [*toks[f.parens[0] + 1 : f.parens[1]], None]:
            if t is None or (depth == 0 and t.sym == ","):
                syms = [x.sym for x in current]
                if "bool" in syms and "*" not in syms and "&" not in syms:
                    names.append(next((x.raw for x in reversed(current) if x.sym == "id"), ""))
                current = []
                continue
            if t.sym in ("(", "[", "{", "<"):
                depth += 1
            elif t.sym in (")", "]", "}", ">"):
                depth -= 1
            elif depth <= 0:
                current.append(t)
        if not (len(names) > 1 or (names and flag.match(names[0]))) or (f.name, f.arity) in seen:
            continue
        seen.add((f.name, f.arity))
        what = f"takes {len(names)} boolean flag parameters" if len(names) > 1 else f"takes a boolean flag parameter '{names[0]}'"
        out.append(("ARG.1.flag_argument_signature", f.start, f"function '{f.name}' {what}"))
    signatures = {f.parens[0] for f in found}
    for k in range(len(toks) - 1):
        if toks[k].sym != "id" or toks[k + 1].sym != "(" or k + 1 in signatures:
            continue
        depth = n = 0
        for t in toks[k + 1 :]:
            if t.sym in PAIRS:
                depth += 1
            elif t.sym in (")", "]", "}"):
                depth -= 1
                if depth == 0:
                    break
            elif depth == 1 and t.sym in ("false", "true"):
                n += 1
        if n > 1:
            out.append(("ARG.2.boolean_literal_call", toks[k].line, f"call passes {n} boolean literals positionally"))
    return out


# -- line rules of headers -------------------------------------------------------------------------------------------


def using_namespaces(src: str) -> list[int]:
    """Lines with ``using namespace`` outside all braces."""
    out, depth, comment = [], 0, False
    for n, line in enumerate(src.split("\n"), 1):
        code = ""
        while line:
            if comment:
                _, end, line = line.partition("*/")
                comment = not end
                continue
            m = re.search(r"//|/\*", line)
            code += line[: m.start()] if m else line
            comment = bool(m) and m.group() == "/*"
            line = line[m.end() :] if comment else ""
        depth += code.count("{")
        if depth == 0 and re.match(r"\s*using\s+namespace\b", code):
            out.append(n)
        depth = max(0, depth - code.count("}"))
    return out


def has_guard(src: str, budget: int = 60) -> bool:
    """``#pragma once`` or an ``#ifndef X`` … ``#define X`` pair within the first lines of code."""
    plain = re.sub(r"/\*.*?(?:\*/|\Z)", lambda m: "\n" * m.group().count("\n"), src, flags=re.S)
    lines = [x for x in (re.sub(r"//.*", "", t).strip() for t in plain.split("\n")) if x][:budget]
    names: set[str] = set()
    for t in lines:
        if re.match(r"#\s*pragma\b.*\bonce\b", t):
            return True
        m = re.match(r"#\s*(ifndef|define)\s+(\w+)", t)
        if m and m[1] == "ifndef":
            names.add(m[2])
        elif m and m[2] in names:
            return True
    return False


def is_objc(src: str) -> bool:
    return any(mark in src for mark in ("#import", "@implementation", "@interface"))
