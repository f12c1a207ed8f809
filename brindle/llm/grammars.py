"""Grammars of C# 13, Python 3.13, JSON (RFC 8259) and XML 1.0 for parsing with derivatives.

They recognise; precedence and meaning don't matter. Where a construct can't be told from another
without knowledge of names (casts, generic names, declarations), both readings are kept in a choice.
"""

from __future__ import annotations

from .derivative import Grammar, Node
from ..functions.lexers import CS_CONTEXTUAL


def csharp() -> tuple[Grammar, Node]:
    g = Grammar()
    R, T, alt, seq, opt, many, sep, star = g.ref, g.tok, g.alt, g.seq, g.opt, g.many, g.sep, g.star
    rule = g.rules.__setitem__
    ID = T("id", *CS_CONTEXTUAL)
    PREDEF = T(*"bool byte char decimal double float int long object sbyte short string uint ulong ushort void".split())
    type_ = R("type")
    expr = R("expr")
    block = R("block")
    stat = R("stat")

    # types
    rule("typeargs", seq("<", alt(sep(type_), many(",")), ">"))
    name_part = seq(ID, opt(R("typeargs")))
    rule("name", seq(opt(ID, "::"), name_part, many(".", name_part)))
    rule("rank", seq("[", many(","), "]"))
    tuple_type = seq("(", type_, opt(ID), many(",", type_, opt(ID)), ")")
    fnptr = seq("delegate", "*", opt(alt("managed", seq("unmanaged", opt("[", sep(ID), "]")))), "<", sep(seq(opt(alt("ref", "in", "out")), opt("readonly"), type_)), ">")
    rule("type", seq(alt(PREDEF, R("name"), tuple_type, fnptr), star(alt("?", "*", R("rank")))))
    rule("creatable", seq(alt(PREDEF, R("name"), tuple_type), opt("?")))
    ref_type = seq(opt("scoped"), opt("ref", opt("readonly")), type_)

    # attributes, parameters
    rule("attr", seq("[", opt(alt(ID, "return", "event"), ":"), R("attribute"), many(",", R("attribute")), opt(","), "]"))
    rule("attribute", seq(R("name"), opt(R("args"))))
    attrs = star(R("attr"))
    arg = seq(opt(ID, ":"), alt(seq(alt("ref", "in"), expr), seq("out", alt(expr, seq(type_, ID))), expr))
    rule("args", seq("(", opt(sep(arg)), ")"))
    rule("index", seq("[", sep(arg), "]"))
    pmods = star(T("ref", "out", "in", "params", "this", "readonly", "scoped"))
    rule("param", seq(attrs, pmods, alt(seq(type_, ID, opt("=", expr)))))
    rule("params", seq("(", opt(alt(seq(sep(R("param")), opt(",", "__arglist")))), ")"))
    rule("tparams", seq("<", sep(seq(attrs, opt(alt("in", "out")), ID)), ">"))
    constraint = alt(type_, "class", seq("class", "?"), "struct", seq("new", "(", ")"), "default", seq("allows", "ref", "struct"))
    constraints = many("where", ID, ":", sep(constraint))

    # patterns
    sub = seq(opt(ID, many(".", ID), ":"), R("pattern"))
    props = seq("{", opt(sep(sub), opt(",")), "}")
    pos = seq("(", opt(sep(sub)), ")")
    listp = seq("[", opt(sep(R("pattern")), opt(",")), "]")
    designation = alt(ID, R("designations"))
    rule("designations", seq("(", opt(sep(alt(ID, R("designations")))), ")"))
    rule("const", seq(R("term"), many(alt(T(*"+ - * / % & | ^ << ".split()), seq(">", ">"), seq(">", ">", ">")), R("term"))))
    rule(
        "pattern",
        seq(
            star(T("not")),
            alt(
                R("const"),
                seq(type_, opt(ID)),
                seq(opt(type_), pos, opt(props), opt(ID)),
                seq(opt(type_), props, opt(ID)),
                seq(T("<", ">", "<=", ">="), R("const")),
                seq("var", designation),
                seq(listp, opt(ID)),
                seq("..", opt(R("pattern"))),
            ),
            many(alt("and", "or"), R("pattern")),
        ),
    )

    # expressions
    init_value = alt(expr, R("init"))
    rule("init", seq("{", opt(sep(alt(init_value, seq(ID, "=", R("init")), seq(R("index"), "=", init_value))), opt(",")), "}"))
    anon_member = expr
    new = seq(
        "new",
        alt(
            seq(R("creatable"), alt(seq(R("args"), opt(R("init"))), R("init"), seq("[", sep(expr), "]", star(alt(R("rank"), "?")), opt(R("init"))), seq(R("rank"), star(alt(R("rank"), "?")), R("init")))),
            seq(R("args"), opt(R("init"))),
            seq(R("rank"), R("init")),
            seq("{", opt(sep(anon_member), opt(",")), "}"),
        ),
    )
    tuple_item = seq(opt(ID, ":"), alt(expr, seq(type_, designation)))
    paren = seq("(", sep(tuple_item), ")")
    hole = seq("h(", expr, opt(",", expr), opt("hf"), "h)")
    interp = seq("i(", star(hole), "i)")
    collection = seq("[", opt(sep(alt(expr, seq("..", expr))), opt(",")), "]")
    anonymous = seq(star(T("async", "static")), "delegate", opt(R("params")), block)
    stackalloc = seq("stackalloc", alt(seq(R("creatable"), "[", opt(expr), "]", opt(R("init"))), seq("[", opt(expr), "]", R("init"))))
    primary = alt(
        T("num", "str", "chr", "true", "false", "null", "this", "base", "default", "__arglist"),
        interp,
        seq(opt(ID, "::"), name_part),
        PREDEF,
        paren,
        new,
        stackalloc,
        collection,
        anonymous,
        seq(alt("typeof", "sizeof", "default"), "(", type_, ")"),
        seq(alt("checked", "unchecked"), "(", expr, ")"),
    )
    arm = seq(R("pattern"), opt("when", expr), "=>", expr)
    member = seq(alt(".", "->"), name_part)
    postfix = alt(
        member,
        seq("?", ".", name_part),
        seq("?", R("index")),
        R("args"),
        R("index"),
        T("++", "--", "!"),
        seq("switch", "{", opt(sep(arm), opt(",")), "}"),
        seq("with", R("init")),
    )
    prefix = alt(T("+", "-", "!", "~", "++", "--", "&", "*", "^", "await"), seq("(", type_, ")"))
    rule("term", seq(star(prefix), primary, star(postfix)))
    lambda_body = alt(expr, block)
    lparam = seq(attrs, pmods, alt(ID, seq(type_, ID)), opt("=", expr))
    lambda_ = seq(attrs, star(T("async", "static")), alt(ID, seq(opt(alt(type_, seq("ref", opt("readonly"), type_))), "(", opt(sep(lparam)), ")")), "=>", lambda_body)
    throw = seq("throw", expr)
    binop = alt(T(*"+ - * / % & | ^ && || == != < > <= >= << ??".split()), seq(">", ">"), seq(">", ">", ">"))
    assign = alt(T(*"= += -= *= /= %= &= |= ^= <<= ??= ".split()), seq(">", ">="), seq(">", ">", ">="))
    q_from = seq("from", opt(type_), ID, "in", expr)
    q_join = seq("join", opt(type_), ID, "in", expr, "on", expr, "equals", expr, opt("into", ID))
    q_order = seq("orderby", sep(seq(expr, opt(alt("ascending", "descending")))))
    q_clause = alt(q_from, seq("let", ID, "=", expr), seq("where", expr), q_join, q_order)
    q_end = alt(seq("select", expr), seq("group", expr, "by", expr))
    rule("query", seq(q_from, star(q_clause), q_end, many("into", ID, star(q_clause), q_end)))
    operand = alt(R("term"), seq("..", opt(R("term"))))
    tail = alt(
        seq(binop, operand),
        seq("..", opt(R("term"))),
        seq("is", R("pattern")),
        seq("as", type_),
        seq("?", expr, ":", expr),
        seq(alt("??", assign), expr),
    )
    rule("expr", alt(seq(operand, star(tail)), lambda_, throw, R("query"), seq("ref", expr)))

    # statements
    vardecl = seq(ID, opt("[", sep(expr), "]"), opt("=", alt(expr, R("init"))))
    local = seq(ref_type, sep(vardecl))
    rule("block", seq("{", star(stat), "}"))
    fn_body = alt(block, seq("=>", expr, ";"), T(";"))
    local_fn = seq(attrs, star(T("static", "async", "unsafe", "extern")), opt("ref", opt("readonly")), type_, ID, opt(R("tparams")), R("params"), constraints, fn_body)
    var_pattern = alt(seq(ref_type, ID), seq("var", R("designations")), expr)
    case = alt(seq("case", R("pattern"), opt("when", expr), ":"), seq("default", ":"))
    catch = seq("catch", opt("(", type_, opt(ID), ")"), opt("when", "(", expr, ")"), block)
    rule(
        "stat",
        alt(
            block,
            T(";"),
            seq(opt("const"), local, ";"),
            seq(opt("await"), "using", local, ";"),
            seq(expr, ";"),
            local_fn,
            seq(ID, ":", stat),
            seq("if", "(", expr, ")", stat, opt("else", stat)),
            seq("while", "(", expr, ")", stat),
            seq("do", stat, "while", "(", expr, ")", ";"),
            seq("for", "(", opt(alt(local, sep(expr))), ";", opt(expr), ";", opt(sep(expr)), ")", stat),
            seq(opt("await"), "foreach", "(", var_pattern, "in", expr, ")", stat),
            seq("switch", alt(paren, R("args")), "{", star(seq(case, star(case), stat, star(stat))), "}"),
            seq("try", block, alt(seq(catch, star(catch), opt("finally", block)), seq("finally", block))),
            seq("lock", "(", expr, ")", stat),
            seq("fixed", "(", local, ")", stat),
            seq(opt("await"), "using", "(", alt(local, expr), ")", stat),
            seq(alt("checked", "unchecked", "unsafe"), block),
            seq("return", opt(expr), ";"),
            seq("throw", opt(expr), ";"),
            seq(alt("break", "continue"), ";"),
            seq("goto", alt(ID, seq("case", expr), "default"), ";"),
            seq("yield", alt(seq("return", expr), "break"), ";"),
        ),
    )

    # declarations
    mods = star(T(*"public private protected internal static abstract sealed virtual override readonly extern unsafe volatile new async partial required ref file const fixed".split()))
    accessor = seq(attrs, star(T("private", "protected", "internal", "readonly")), alt("get", "set", "init", "add", "remove"), alt(block, seq("=>", expr, ";"), T(";")))
    accessors = seq("{", star(accessor), "}")
    member_name = R("name")
    method = seq(ref_type, member_name, opt(R("tparams")), R("params"), constraints, fn_body)
    ctor = seq(ID, R("params"), opt(":", alt("base", "this"), R("args")), fn_body)
    dtor = seq("~", ID, "(", ")", fn_body)
    prop = seq(ref_type, member_name, alt(seq(accessors, opt("=", expr, ";")), seq("=>", expr, ";")))
    indexer_name = alt("this", R("qualthis"))
    rule("qualthis", seq(name_part, ".", alt("this", R("qualthis"))))
    indexer = seq(ref_type, indexer_name, "[", sep(R("param")), "]", alt(accessors, seq("=>", expr, ";")))
    field_ = seq(type_, sep(vardecl), ";")
    event = seq("event", type_, alt(seq(sep(seq(ID, opt("=", expr))), ";"), seq(member_name, accessors)))
    ops = alt(T(*"+ - ! ~ ++ -- true false * / % & | ^ << == != < > <= >=".split()), seq(">", ">"), seq(">", ">", ">"))
    operator = seq(type_, opt(R("qualop")), "operator", opt("checked"), ops, R("params"), fn_body)
    rule("qualop", seq(name_part, ".", opt(R("qualop"))))
    conversion = seq(alt("implicit", "explicit"), opt(R("qualop")), "operator", opt("checked"), type_, R("params"), fn_body)
    base_list = seq(":", type_, opt(R("args")), many(",", type_))
    body = seq("{", star(R("member")), "}", opt(";"))
    class_like = seq(
        alt("class", "struct", "interface", seq("record", opt(alt("class", "struct")))),
        ID, opt(R("tparams")), opt(R("params")), opt(base_list), constraints, alt(body, T(";")),
    )
    enum_member = seq(attrs, ID, opt("=", expr))
    enum = seq("enum", ID, opt(":", type_), "{", opt(sep(enum_member), opt(",")), "}", opt(";"))
    delegate = seq("delegate", ref_type, ID, opt(R("tparams")), R("params"), constraints, ";")
    rule("typedecl", alt(class_like, enum, delegate))
    rule("member", seq(attrs, mods, alt(R("typedecl"), method, ctor, dtor, prop, indexer, field_, event, operator, conversion)))
    extern = seq("extern", "alias", ID, ";")
    using = seq(opt("global"), "using", alt(seq(opt("static"), opt("unsafe"), R("name")), seq(opt("unsafe"), ID, "=", type_)), ";")
    rule("nsmember", alt(seq(attrs, mods, R("typedecl")), seq(attrs, R("namespace"))))
    inner = seq(star(extern), star(using), star(R("nsmember")))
    rule("namespace", seq("namespace", R("name"), "{", inner, "}", opt(";")))
    file_ns = seq("namespace", R("name"), ";", star(extern), star(using), star(R("nsmember")))
    top = alt(R("nsmember"), stat)
    global_attr = seq("[", alt("assembly", "module"), ":", R("attribute"), many(",", R("attribute")), opt(","), "]")
    unit = seq(star(extern), star(using), star(global_attr), star(top), opt(attrs, file_ns))
    return g, unit


def python() -> tuple[Grammar, Node]:
    g = Grammar()
    R, T, alt, seq, opt, many, sep, star = g.ref, g.tok, g.alt, g.seq, g.opt, g.many, g.sep, g.star
    rule = g.rules.__setitem__
    ID = T("id", "match", "case", "type")
    expr = R("expr")  # without walrus, with a conditional or a lambda
    named = R("named")
    def commas(x):
        return seq(x, many(",", x), opt(","))

    star_expr = seq("*", R("bit"))
    star_named = alt(named, star_expr)
    exprs = commas(alt(expr, star_expr))  # star_expressions
    named_exprs = commas(star_named)
    comp = seq(opt("async"), "for", R("targets"), "in", R("or"), many("if", R("cond_if")))
    comps = seq(comp, star(comp))
    rule("cond_if", alt(seq(opt(ID, ":="), R("or"))))
    slice_ = alt(seq(opt(expr), ":", opt(expr), opt(":", opt(expr))), star_named)
    # arguments in their order: by place or unpacked, then by name or unpacked, then by name or from a mapping
    by_name, unpacked, mapping = seq(ID, "=", expr), seq("*", expr), seq("**", expr)
    named_on = seq(many(",", alt(by_name, unpacked)), many(",", alt(by_name, mapping)))
    arguments = alt(seq(alt(named, unpacked), many(",", alt(named, unpacked)), named_on), seq(by_name, named_on), seq(mapping, many(",", alt(by_name, mapping))))
    rule("call", seq("(", opt(alt(seq(named, comps), seq(arguments, opt(",")))), ")"))
    rule("bases", seq("(", opt(arguments, opt(",")), ")"))
    rule("subscript", seq("[", commas(slice_), "]"))
    hole = R("hole")
    rule("hole", seq("h(", alt(exprs, R("yield")), opt("="), opt("!", ID), opt("h:", star(hole)), "h)"))
    fstring = seq("f(", star(hole), "f)")
    strings = seq(alt("str", fstring), star(alt("str", fstring)))
    dict_item = alt(seq(expr, ":", expr), seq("**", R("bit")))
    atom = alt(
        ID,
        T("num", "True", "False", "None", "..."),
        strings,
        seq("(", opt(alt(named_exprs, seq(star_named, comps), R("yield"))), ")"),
        seq("[", opt(alt(named_exprs, seq(star_named, comps))), "]"),
        seq("{", opt(alt(commas(dict_item), seq(dict_item, comps), named_exprs, seq(star_named, comps))), "}"),
    )
    trailer = alt(seq(".", ID), R("call"), R("subscript"))
    primary = seq(opt("await"), atom, star(trailer))
    rule("factor", seq(star(T("+", "-", "~")), primary, opt("**", R("factor"))))
    rule("bit", seq(R("factor"), many(T(*"| ^ & << >> + - * / // % @".split()), R("factor"))))
    cmp = alt(T("==", "!=", "<", ">", "<=", ">=", "in", "is"), seq("not", "in"), seq("is", "not"))
    rule("not", seq(star(T("not")), R("bit"), many(cmp, R("bit"))))
    rule("or", seq(R("not"), many(T("and", "or"), R("not"))))

    def parameters(plain, starred):
        """Parameters in their order: without defaults before those with, one slash after some, then a
        star or a starred one with those by name after it, then the mapping."""
        default = seq(plain, "=", expr)
        plains, defaults, slash, any_ = many(",", plain), many(",", default), seq(",", "/"), alt(plain, default)
        mapped = seq("**", plain)
        by_place = alt(seq(plain, plains, alt(seq(opt(slash), plains, defaults), seq(",", default, defaults, slash, defaults))), seq(default, defaults, opt(slash), defaults))
        by_name = alt(seq("*", alt(seq(starred, many(",", any_)), seq(",", any_, many(",", any_))), opt(",", mapped)), mapped)
        return seq(alt(seq(by_place, opt(",", by_name)), by_name), opt(","))

    rule("lambda", seq("lambda", opt(parameters(ID, ID)), ":", expr))
    rule("expr", alt(seq(R("or"), opt("if", R("or"), "else", expr)), R("lambda")))
    rule("named", seq(opt(ID, ":="), expr))
    rule("yield", seq("yield", alt(seq("from", expr), opt(exprs))))
    # targets of assignments, for and with: what can be assigned to, starred or not
    t_trailers = star(trailer)
    target_end = alt(seq(".", ID), R("subscript"))
    rule("target", alt(
        ID,
        seq(alt(ID, T("num", "True", "False", "None", "..."), strings, seq("(", opt(alt(named_exprs, seq(star_named, comps), R("yield"))), ")"), seq("[", opt(alt(named_exprs, seq(star_named, comps))), "]"), seq("{", opt(alt(commas(dict_item), named_exprs)), "}")), t_trailers, target_end),
        seq("(", opt(R("targets")), ")"),
        seq("[", opt(R("targets")), "]"),
    ))
    single = R("target")
    rule("targets", commas(alt(single, seq("*", single))))
    value = alt(exprs, R("yield"))
    assign = seq(R("targets"), "=", many(R("targets"), "="), value)
    simple = alt(
        assign,
        seq(single, ":", expr, opt("=", value)),
        seq(single, "aug", value),
        exprs,
        R("yield"),
        T("pass", "break", "continue"),
        seq("return", opt(exprs)),
        seq("raise", opt(expr, opt("from", expr))),
        seq(alt("global", "nonlocal"), sep(ID)),
        seq("del", R("targets")),
        seq("assert", expr, opt(",", expr)),
        seq("import", sep(R("as_name"))),
        seq("from", alt(seq(star(T(".", "...")), R("dotted")), seq(T(".", "..."), star(T(".", "...")))), "import", alt("*", sep(R("as_id")), seq("(", commas(R("as_id")), ")"))),
        seq("type", ID, opt(R("tparams")), "=", expr),
    )
    rule("dotted", seq(ID, many(".", ID)))
    rule("as_name", seq(R("dotted"), opt("as", ID)))
    rule("as_id", seq(ID, opt("as", ID)))
    rule("tparams", seq("[", commas(alt(seq(ID, opt(":", expr), opt("=", expr)), seq("*", ID, opt("=", alt(expr, star_expr))), seq("**", ID, opt("=", expr)))), "]"))
    rule("simple", seq(simple, many(";", simple), opt(";"), "newline"))
    block = alt(R("simple"), seq("newline", "indent", R("stat"), star(R("stat")), "dedent"))
    rule("block", block)
    B = R("block")
    params = parameters(seq(ID, opt(":", expr)), seq(ID, opt(":", alt(expr, star_expr))))
    funcdef = seq("def", ID, opt(R("tparams")), "(", opt(params), ")", opt("->", expr), ":", B)
    classdef = seq("class", ID, opt(R("tparams")), opt(R("bases")), ":", B)
    decorators = many("@", named, "newline")
    else_ = seq("else", ":", B)
    if_ = seq("if", named, ":", B, many("elif", named, ":", B), opt(else_))
    while_ = seq("while", named, ":", B, opt(else_))
    for_ = seq("for", R("targets"), "in", exprs, ":", B, opt(else_))
    with_item = seq(expr, opt("as", single))
    with_ = seq("with", alt(sep(with_item), seq("(", commas(with_item), ")")), ":", B)
    except_ = seq("except", expr, opt("as", ID), ":", B)
    except_star = seq("except", "*", expr, opt("as", ID), ":", B)
    bare = seq("except", ":", B)
    try_ = seq("try", ":", B, alt(
        seq(alt(seq(except_, star(except_), opt(bare)), bare, seq(except_star, star(except_star))), opt(else_), opt("finally", ":", B)),
        seq("finally", ":", B),
    ))
    # match: the subject line, then case blocks
    number = seq(opt("-"), "num", opt(T("+", "-"), "num"))
    dotted_value = seq(ID, many(".", ID))
    pat_seq = commas(alt(R("pattern"), seq("*", ID)))
    map_item = alt(seq(alt(number, strings, T("True", "False", "None"), dotted_value), ":", R("pattern")), seq("**", ID))
    class_arg = alt(R("pattern"), seq(ID, "=", R("pattern")))
    closed = alt(
        number, strings, T("True", "False", "None"),
        seq(dotted_value, opt("(", opt(commas(class_arg)), ")")),
        seq("(", opt(pat_seq), ")"),
        seq("[", opt(pat_seq), "]"),
        seq("{", opt(commas(map_item)), "}"),
    )
    rule("pattern", seq(closed, many("|", closed), opt("as", ID)))
    case_ = seq("case", pat_seq, opt("if", named), ":", B)
    case_star = seq("case", "*", ID, ",", opt(pat_seq), opt("if", named), ":", B)
    cases = alt(case_, case_star)
    match_ = seq("match", named_exprs, ":", "newline", "indent", cases, star(cases), "dedent")
    rule("stat", alt(
        R("simple"), if_, while_, try_, match_,
        seq(opt("async"), alt(for_, with_)),
        seq(decorators, alt(seq(opt("async"), funcdef), classdef)),
    ))
    return g, star(R("stat"))


def json() -> tuple[Grammar, Node]:
    g = Grammar()
    R, alt, seq, opt, sep = g.ref, g.alt, g.seq, g.opt, g.sep
    pair = seq("str", ":", R("value"))
    g.rules["value"] = alt("str", "num", "word", seq("[", opt(sep(R("value"))), "]"), seq("{", opt(sep(pair)), "}"))
    return g, R("value")


def xml() -> tuple[Grammar, Node]:
    """The derivative by an opening tag is its content and a closing tag of the same name."""
    g = Grammar()
    alt, seq, opt, star, T = g.alt, g.seq, g.opt, g.star, g.tok

    def rest(name: str) -> Node:
        return seq(star(g.ref("content")), g.data("close", same(name)))

    checks: dict = {}

    def same(name: str):
        if name not in checks:
            checks[name] = lambda value: g.eps if value == name else g.empty
        return checks[name]

    def nothing(_: str) -> Node:
        return g.eps

    element = alt(g.data("open", rest), g.data("empty", nothing))
    g.rules["element"] = element
    g.rules["content"] = alt(g.ref("element"), T("text", "space", "cdata", "comment", "pi"))
    misc = star(T("comment", "pi", "space"))
    return g, seq(opt("decl"), misc, opt("doctype", misc), g.ref("element"), misc)
