"""Scalar functions F1-F20 as column expressions; Python only where a scan needs a stack."""

from __future__ import annotations

import json
import re

import pandas as pd
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T


#: White space that trims off both ends.
WHITE = " \t\n\x0b\x0c\r"


def stripped(x: Column) -> Column:
    return F.btrim(x, F.lit(WHITE))


def norm_api(name: Column) -> Column:
    """F1: runs of leading underscores shrink to two; a single one goes unless the name is mangled."""
    x = F.regexp_replace(F.coalesce(name, F.lit("")), "^_{3,}", "__")
    return F.when(x.startswith("_Z") | x.startswith("__"), x).otherwise(F.regexp_replace(x, "^_", ""))


def api_category(df: DataFrame, categories: DataFrame, api: str = "api") -> DataFrame:
    """adds category by normalised name, ``other`` for the rest. The table's size is that of a resource file."""
    known = F.broadcast(categories.select(F.col("api").alias("__api"), "category"))
    return df.join(known, norm_api(F.col(api)) == F.col("__api"), "left").drop("__api").withColumn("category", F.coalesce("category", F.lit("other")))


def bucket_log2(x: Column) -> Column:
    """0 for x <= 0, else floor(log2 x) + 1."""
    return F.when(x <= 0, F.lit(0)).otherwise(F.floor(F.log2(x)) + 1).cast("long")


def hash_feature(feature: Column, dim: int) -> tuple[Column, Column]:
    """(index, sign) from the md5 of a feature: bytes 0-3, little-endian, modulo dim; parity of byte 4."""
    m = F.md5(feature)
    word = F.concat(F.substring(m, 7, 2), F.substring(m, 5, 2), F.substring(m, 3, 2), F.substring(m, 1, 2))
    odd = F.conv(F.substring(m, 10, 1), 16, 10).cast("int") % 2
    return (F.conv(word, 16, 10).cast("long") % dim).cast("long"), F.when(odd == 0, 1.0).otherwise(-1.0)


# Registers, symbol beginnings and mnemonics that operand and token kinds depend on.
REGISTER = r"(?i)^(r(1[0-5]|[0-9])|e?(ax|bx|cx|dx|si|di|bp|sp)|[abcd][lh]|[sd]il|[sb]pl|r(ip)|xmm\d+|ymm\d+|zmm\d+|mm\d+|st\(\d+\))$"
SYMBOL = r"^(loc_|sub_|off_|a[A-Za-z]|dword_|qword_|byte_|word_)"
RETURNS = ["ret", "retn", "retf"]
PAIRED = ["mov", "movzx", "movsx", "lea", "add", "sub", "imul", "mul", "idiv", "div", "and", "or", "xor", "shl", "shr", "sar", "sal", "inc", "dec", "neg", "not", "cmpxchg", "xchg", "cmp", "test"]


def operand_type(op: Column) -> Column:
    """NONE, MEM, IMM, REG, SYM or OTHER; the first rule that fits."""
    x = stripped(op)
    return (
        F.when(x == "", "NONE").when(x.contains("[") | x.contains("]") | x.rlike("(?i)^[a-z]{1,3}:"), "MEM")
        .when(x.rlike(r"^-?(0x[0-9a-fA-F]+|\d+)$"), "IMM").when(x.rlike(REGISTER), "REG").when(x.rlike(SYMBOL), "SYM").otherwise("OTHER")
    )


def insn_tokens(code: DataFrame, imports: DataFrame, internal: DataFrame) -> DataFrame:
    """(item_id, func, pos, token) of every instruction line of code (item_id, func, disasm).

    imports (item_id, api) and internal (item_id, name) tell API calls from internal ones.
    """
    lines = code.select("item_id", "func", F.posexplode(F.split("disasm", r"\R")).alias("pos", "raw"))
    lines = lines.withColumn("line", stripped(F.regexp_replace(stripped(F.col("raw")), ";.*$", ""))).where("line <> '' and not endswith(line, ':') and not startswith(line, '.')")
    lines = lines.withColumn("mnem", F.lower(F.regexp_extract("line", r"^(\S+)", 1))).where(~F.col("mnem").rlike("^(loc_|sub_|off_)") & (F.col("mnem") != "nop"))
    lines = lines.withColumn("rest", stripped(F.regexp_replace("line", r"^\S+\s*", ""))).withColumn("ops", F.split("rest", ","))
    callee = stripped(F.regexp_replace(stripped(F.regexp_replace(stripped(F.get("ops", F.lit(0))), "short", "")), "near ptr|far ptr", ""))
    lines = lines.withColumn("callee", callee).withColumn("norm", norm_api(F.col("callee")))
    apis = imports.select(F.col("item_id").alias("i1"), F.col("api").alias("a1")).distinct()
    exact = apis.withColumnsRenamed({"i1": "i2", "a1": "a2"})
    own = internal.select(F.col("item_id").alias("i3"), F.col("name").alias("n3")).distinct()
    joined = (
        lines.join(apis, (F.col("item_id") == F.col("i1")) & (F.col("norm") == F.col("a1")), "left")
        .join(exact, (F.col("item_id") == F.col("i2")) & (F.col("callee") == F.col("a2")), "left")
        .join(own, (F.col("item_id") == F.col("i3")) & (F.col("callee") == F.col("n3")), "left")
    )
    m, upper = F.col("mnem"), F.upper("mnem")
    call = (
        F.when(F.col("rest") == "", "CALL").when(operand_type(F.col("callee")).isin("REG", "MEM"), "CALL_IND")
        .when(F.col("a1").isNotNull() | F.col("a2").isNotNull(), F.concat(F.lit("CALL_API:"), "norm"))
        .when(F.col("n3").isNotNull() | F.col("callee").startswith("sub_") | (F.col("callee") == "main"), "CALL_INT").otherwise("CALL_EXT")
    )
    pair = F.when(F.size("ops") >= 2, F.concat_ws("_", upper, operand_type(F.get("ops", F.lit(0))), operand_type(F.get("ops", F.lit(1))))).otherwise(upper)
    token = (
        F.when(m.isin(RETURNS), "RET").when(m == "call", call)
        .when(m.isin("jmp", "jmpq", "jmpl"), "JMP").when(m.isin("jrcxz", "jecxz", "jcxz"), "JX").when(m.startswith("j"), "JCC")
        .when(m.startswith("set"), "SETCC").when(m.startswith("cmov"), "CMOVCC").when(m.isin(PAIRED), pair).otherwise(upper)
    )
    return joined.select("item_id", "func", "pos", token.alias("token"))


def strip_prefix(name: Column) -> Column:
    """Each import marker goes once from the beginning, in this order: a dot, _imp_, __imp_."""
    for marker in (r"^\.", "^_imp_", "^__imp_"):
        name = F.regexp_replace(name, marker, "")
    return name


def short_name(demangled: Column) -> Column:
    """the last token before the argument list, calling conventions aside; operators stay whole."""
    head = F.trim(F.regexp_replace(demangled, r"\(.*$", ""))
    head = F.regexp_replace(head, r"\b(__cdecl|__stdcall|__fastcall|__thiscall|__usercall)\b", "")
    return F.when(head.rlike(r"operator\W"), F.regexp_extract(head, r"(\S*operator.*)$", 1)).otherwise(F.regexp_extract(F.trim(head), r"(\S+)$", 1))


def clean_symbol(name: Column) -> Column:
    """letters, digits and underscores; a leading digit gets f_."""
    x = F.regexp_replace(name, "[^A-Za-z0-9_]", "_")
    return F.when(x.rlike("^[0-9]"), F.concat(F.lit("f_"), x)).otherwise(x)


def int_ascii(value: Column) -> Column:
    """a whole number over 255 as big-endian printable ASCII of two to eight bytes, else null."""
    h = F.hex(value)
    h = F.when(F.length(h) % 2 == 1, F.concat(F.lit("0"), h)).otherwise(h)
    text = F.decode(F.unhex(h), "ISO-8859-1")
    return F.when((value > 255) & F.length(text).between(2, 8) & ~text.rlike("[^ -~]"), text)  # $ would pass an end of line


def _balanced(text: str, opens: str, closes: str) -> str | None:
    """The stretch from the first opening bracket to the one that closes it, strings respected; one pass."""
    start = text.find(opens)
    depth, quoted, escaped = 0, False, False
    for k in range(start, len(text)) if start >= 0 else ():
        c = text[k]
        if quoted:
            quoted, escaped = (c != '"' or escaped), (c == "\\" and not escaped)
        elif c == '"':
            quoted = True
        elif c == opens:
            depth += 1
        elif c == closes:
            depth -= 1
            if depth == 0:
                return text[start : k + 1]
    return None


def extract_json_text(text: str | None) -> str | None:
    """the JSON in a reply: BOM and a fence about the whole text off, the whole, a balanced object or array, a rough cut, or the text."""
    if text is None:
        return None
    s = text.lstrip("\ufeff").strip()
    fenced = re.fullmatch(r"```(?:json|JSON)?\s*(.*?)\s*```", s, re.S)
    s = fenced.group(1).strip() if fenced else s
    try:
        json.loads(s)
        return s
    except ValueError:
        pass
    for opens, closes in ("{}", "[]"):
        found = _balanced(s, opens, closes)
        if found:
            return found
        a, b = s.find(opens), s.rfind(closes)
        if 0 <= a < b:
            return s[a : b + 1]
    return s


def first_object(text: str | None, required: tuple[str, ...]) -> str | None:
    """the first JSON object that has the required keys, thoughts and fences off; null if none."""
    if text is None:
        return None
    s = re.sub(r"<think>.*?</think>", "", text, flags=re.S | re.I)
    # What comes before an unpaired end of a thought is thought too.
    end = s.lower().rfind("</think>")
    s = re.sub(r"</?think\s*>", "", s[end + 8 :] if end >= 0 else s, flags=re.I)
    s = re.sub(r"```(?:json)?\s*", "", s, flags=re.I)
    decoder, at = json.JSONDecoder(), s.find("{")
    while at >= 0:
        try:
            value, end = decoder.raw_decode(s, at)
            if isinstance(value, dict) and all(k in value for k in required):
                return s[at:end]
        except ValueError:
            pass
        at = s.find("{", at + 1)
    return None


def json_objects(df: DataFrame, text: str, out: str, required: tuple[str, ...] | None = None) -> DataFrame:
    """F12 (no required keys) or F13 over a column, Arrow batch by batch."""
    from factweave.sources.store import importable

    importable(df.sparkSession)
    @F.pandas_udf(T.StringType())
    def found(texts: pd.Series) -> pd.Series:
        return texts.map(lambda t: extract_json_text(t) if required is None else first_object(t, required))

    return df.withColumn(out, found(F.col(text)))


# How evidence, import lists and gates read in a prompt.
EVIDENCE = {
    "stack": "{i}.stack_lvar for Function: {func} | Variable: {var}\nThe local variable is stored in the {reg_or_stack}.\nIts data type is {lvar_type}, with a size of {lvar_size} bytes.",
    "distance": "\nIt is located {dist_to_ret} bytes away from the return address and has an offset of {offset_to_sp} from the stack pointer.",
    "global_var": "{i}.global_var for Variable: {var}\nThe global variable has type {global_var_type} and size {global_var_size} bytes, located at address {addr_ea}.",
    "references": "\nIt is referenced by the following functions: {refs}",
    "inner_call": "{i}.inner_call for Function: {func}",
    "callee": "\nIt internally calls {name}, which is classified as {kind}.",
    "fetch_pcode": "{i}.fetch_pcode for Function: {func}\nThe function's decompiled P-code is: {pcode}",
    "fetch_disasm": "{i}.fetch_disasm for Function: {func}\nThe function's disassembly is: {ehasm}",
}
IMPORT_SENTENCE = "The {func} API comes from {lib}; its function prototype is '{proto}';"
GATE_HEADER = "Minimum Primitive Set for Satisfying Obligation Requirements:"
GATE_LINE = "{key}'s minimum primitive set: [{items}]"
UPDATE_HINT = "\n\nObligation-status update gate check failed for {bad}; please re-update ONLY these obligations and ensure update_from cites at least one evidence ID whose query_type matches each obligation's minimum primitive set."


def _filled(template: str, value) -> Column:
    """The template's {name} places filled with value(name)."""
    parts = re.split(r"\{(\w+)\}", template)
    return F.concat(*[F.lit(x) if k % 2 == 0 else value(x) for k, x in enumerate(parts)])


def render_evidence(number: Column, kind: Column, func: Column, var: Column, params: Column, calls: Column, refs: Column) -> Column:
    """the numbered text of each kind of evidence, without newlines at its end.

    ``params`` is a map of strings, ``calls`` an array of (name, kind), ``refs`` an array of function names; a missing
    value reads None.
    """
    own = {"i": number.cast("string"), "func": func, "var": var, "refs": F.array_join(refs, ", ")}
    value = lambda name: F.coalesce(own[name] if name in own else F.try_element_at(params, F.lit(name)), F.lit("None"))
    text = {k: _filled(t, value) for k, t in EVIDENCE.items() if k != "callee"}
    callee = lambda c: _filled(EVIDENCE["callee"], lambda name: F.coalesce(c[name], F.lit("None")))
    in_register = F.coalesce(F.try_element_at(params, F.lit("reg_or_stack")) == "Register", F.lit(False))
    said = (
        F.when(kind == "stack_lvar", F.concat(text["stack"], F.when(in_register, "").otherwise(text["distance"])))
        .when(kind == "global_var", F.concat(text["global_var"], F.when(F.size(refs) > 0, text["references"]).otherwise("")))
        .when(kind == "inner_call", F.concat(text["inner_call"], F.array_join(F.transform(calls, callee), "")))
        .when(kind == "fetch_pcode", text["fetch_pcode"]).when(kind == "fetch_disasm", text["fetch_disasm"])
    )
    return F.rtrim(said, F.lit("\n"))


def import_sentences(imports: Column) -> Column:
    """a sentence for each import of an array of (func, lib, proto), one a line; what is missing or empty is UNKNOWN."""
    known = lambda x: lambda name: F.when(x[name] != "", x[name]).otherwise("UNKNOWN")
    return F.array_join(F.transform(imports, lambda x: _filled(IMPORT_SENTENCE, known(x))), "\n")


def code_text(bodies: Column) -> Column:
    """pseudo-code bodies, a blank line between them, no newlines at the end."""
    return F.rtrim(F.array_join(bodies, "\n\n"), F.lit("\n"))


# Titles of the supported weakness classes and names of the signals.
CWE_TITLES = {"121": "Stack-based Buffer Overflow", "122": "Heap-based Buffer Overflow", "78": "OS Command Injection", "134": "Use of Externally-Controlled Format String", "789": "Memory Allocation with Excessive Size Value", "787": "Out-of-bounds Write", "125": "Out-of-bounds Read", "476": "NULL Pointer Dereference", "369": "Divide By Zero"}
SIGNALS = {4: "SIGILL", 5: "SIGTRAP", 6: "SIGABRT", 7: "SIGBUS", 8: "SIGFPE", 9: "SIGKILL", 11: "SIGSEGV", 13: "SIGPIPE", 15: "SIGTERM", 31: "SIGSYS"}


def _lookup(table: dict, key: Column) -> Column:
    return F.try_element_at(F.create_map(*[F.lit(x) for kv in table.items() for x in kv]), key)


def cwe_title(code: Column) -> Column:
    """F16: CWE-n: title, or CWE-n alone."""
    return F.concat_ws(": ", F.concat(F.lit("CWE-"), code), _lookup(CWE_TITLES, code))


def render(template: str, values: dict[str, Column]) -> Column:
    """fills {{ name }} places; null gives nothing; an unknown name is an error, not an empty place."""
    parts = re.split(r"\{\{\s*(\w+)\s*\}\}", template)
    return F.concat(*[F.lit(p) if k % 2 == 0 else F.coalesce(values[p].cast("string"), F.lit("")) for k, p in enumerate(parts)])


def signal_name(number: Column) -> Column:
    """F18."""
    return F.coalesce(_lookup(SIGNALS, number), F.concat(F.lit("SIG"), number.cast("string")))


def gate_text(gates: Column) -> Column:
    """a header and a line an obligation, in order, with its distinct sorted requirements; ``gates`` is a map of arrays."""
    items = lambda k: F.array_join(F.array_sort(F.array_distinct(F.coalesce(gates[k], F.array().cast("array<string>")))), ", ")
    lines = F.transform(F.array_sort(F.map_keys(gates)), lambda k: _filled(GATE_LINE, lambda name: k if name == "key" else items(k)))
    return F.concat_ws("\n", F.lit(GATE_HEADER), F.array_join(lines, "\n"))


def chunks(df: DataFrame, k: int, *order: str, by: tuple[str, ...] = ()) -> DataFrame:
    """chunk 1..k, sizes differing by one at most, the first ones larger."""
    from pyspark.sql import Window

    return df.withColumn("chunk", F.ntile(k).over(Window.partitionBy(*by).orderBy(*order)))


def error_hint(message: Column, failed: Column) -> Column:
    """the message, and what to say about the obligations that failed, in the order given; none leaves it as it is."""
    hint = _filled(UPDATE_HINT, lambda _: F.array_join(failed, ","))
    return F.when(F.size(failed) > 0, F.concat(F.rtrim(message, F.lit("\n")), hint)).otherwise(message)
