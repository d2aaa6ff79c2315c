"""Token rules and grammars of the parsed languages; each grammar accepts a superset of its language's structure."""

from __future__ import annotations

import ast
import re
import warnings
from functools import cache

from treeloom.sources.grammar import compile_grammar, first_error

_SCRIPT_TOKENS = re.compile(
    r"""[ \t\f\v ﻿]*(?:(?P<NL>[\r\n  ]\s*)|(?P<ID>(?:\#?(?:[^\W\d]|\$)|\\u)(?:[\w$‌‍]|\\u)*)|(?P<CO>//[^\r\n  ]*|/\*[\s\S]*?\*/)
    |(?P<NUM>0[xXbBoO][\da-fA-F_]+n?|(?:\d[\d_]*\.?[\d_]*|\.\d[\d_]*)(?:[eE][+-]?\d+)?n?)(?![\w$])
    |(?P<STR>"(?:[^"\\\r\n]|\\(?:\r\n|[\s\S]))*"|'(?:[^'\\\r\n]|\\(?:\r\n|[\s\S]))*')
    |(?P<TPL>`(?:[^`\\$]|\\[\s\S]|\$(?!\{)|\$\{(?:[^{}`]|`[^`]*`|\{[^{}]*\})*\})*`)
    |(?P<OP>\.\.\.|=>|===|!==|\*\*=|&&=|\|\|=|\?\?=|==|!=|<=|&&|\|\||\?\?|\?\.(?!\d)|\+\+|--|\+=|-=|\*=|/=|%=|&=|\|=|\^=|\*\*|<<=|<<|[{}()\[\];,<>+\-*/%&|^!~?:=.@])|(?P<BAD>.))|[ \t\f\v ﻿]+$""",
    re.X,
)
_REGEX = re.compile(r"/(?![*/])(?:[^/\\\[\r\n]|\\.|\[(?:[^\]\\\r\n]|\\.)*\])+/[a-z]*")
_KINDS = {"...": "...", "=>": "=>", "++": "INC", "--": "INC", "+": "PM", "-": "PM", "!": "PRE", "~": "PRE", "?.": "?."}
_KINDS |= {c: c for c in "{}()[];,<>*?:=.@|&"}
#: Fixed: reserved words of the scripts that begin or join phrases.
_WORDS = "var let const if else for while do return break continue throw try catch finally switch case default function class extends import export from as of in instanceof new typeof void delete async await yield debugger super this null true false static get set"
_TYPE_WORDS = "interface type enum namespace declare abstract implements public private protected readonly keyof is infer satisfies"
_NAMES = "from as of async get set static type declare abstract namespace readonly keyof is infer satisfies let this super null true false public private protected interface implements enum"
_UNARY = "typeof delete await yield"

_SCRIPT = """
Program = Stmts
Stmts = Stmt Stmts |
Block = { Stmts }
Stmt = Block | ; | VARKW Vars SEMI | if ( Expr ) Stmt Else | for Aw ( For | while ( Expr ) Stmt | do Stmt while ( Expr ) SEMI | return OExpr SEMI | break OId SEMI | continue OId SEMI | throw Expr SEMI | try Block Catch Fin | switch ( Expr ) { Cases } | function Fun | class Class | import Imp | export Exp | debugger SEMI | @ E Stmt | async AsyncStmt {TS} | Expr LabelOrEnd
AsyncStmt = function Fun | Arrowish SEMI
Arrowish = ( Args ) RetArrow | Name => Body | Post Tail More
RetArrow = AC Type => Body | => Body | Post Tail More
LabelOrEnd = : Stmt | SEMI
Aw = await |
Else = else Stmt |
OId = Name |
OExpr = Expr |
Catch = catch CatchArg Block |
CatchArg = ( Bind TAnn ) |
Fin = finally Block |
Cases = case Expr : Stmts Cases | default : Stmts Cases |
For = VARKW Bind TAnn ForVar | ; ForCond | Expr ForRest
ForVar = = E MoreVars ForRest | of Expr ) Stmt | in Expr ) Stmt | MoreVars ForRest
ForRest = ; ForCond | of Expr ) Stmt | ) Stmt
ForCond = OExpr ; OExpr ) Stmt
Vars = Bind Bang TAnn Init MoreVars
MoreVars = , Vars |
Bind = Name | ObjLit | [ Elems ]
Init = = E |
Expr = E More
More = , E More |
E = PM E | PRE E | INC E | UNARY E | VOID E | P Post Tail | new E | async Arrowish | ... E | TLT Types TGT E
P = ID | NAMEKW | NUM | STR | TPL | REGEX | function Fun | class Class | [ Elems ] | ObjLit | ( Args ) ArrowRet | import ImpCall | this | get | set | static | of | from | as
ImpCall = ( Args ) | . Word
ArrowRet = AC Type |
Post = . Word Post | ?. OptPost Post | [ Expr ] Post | ( Args ) Post | TPL Post | INC Post | PRE Post | TLT Types TGT Post |
OptPost = Word | [ Expr ] | ( Args ) | TLT Types TGT ( Args )
Tail = BIN E | PM E | * E | = E | | E | & E | < E | > Gt E | ? Tern | => Body | in E | instanceof E | as Type Tail |
Gt = > Gt | = |
Tern = E : E Tail {TERN}
Body = Block | E
Args = Arg MoreArgs |
Arg = ... E TAnn | E TAnn
MoreArgs = , Args |
Elems = , Elems | E ElemsNext |
ElemsNext = , Elems |
ObjLit = { Props }
Props = Prop MoreProps |
MoreProps = , Props |
Prop = ... E | * Prop | Key PropRest
Key = Word | STR | NUM | [ E ]
PropRest = : E | = E | ( Params ) Ret Block | TPar ( Params ) Ret Block | Key PropRest | * Key PropRest |
Word = ID | NAMEKW | KW | VARKW | UNARY | VOID | KEYS
Name = ID | NAMEKW | of | from | as | get | set | static | async | this
Fun = Star OName TPar ( Params ) Ret FunEnd
Star = * |
OName = Name |
Params = Param MoreParams |
MoreParams = , Params |
Param = ... Bind TAnn Init | @ E Param | Bind {MOD} Opt TAnn Init
Opt = ? |
Bang = PRE |
Class = OName TPar Heritage { Members }
Heritage = extends E Heritage | implements Types Heritage |
Members = Member Members |
Member = ; | @ E Member | * Key MemberRest | Key MemberRest | { Stmts }
MemberRest = TPar ( Params ) Ret FunEnd | ( Params ) Ret FunEnd | ? MemberRest | PRE TAnn Init SEMI | : Type Init SEMI | = E SEMI | * Key MemberRest | Key MemberRest | Block | SEMI
FunEnd = Block {DECL}
Imp = STR SEMI | ( Args ) Post Tail More SEMI | . Word Post Tail More SEMI | * as Name from STR SEMI | { Specs } from STR SEMI | {ITYPE} Name ImpNext
ImpNext = , ImpMore | from STR SEMI | = Expr SEMI
ImpMore = * as Name from STR SEMI | { Specs } from STR SEMI
Specs = Spec MoreSpecs |
MoreSpecs = , Specs |
Spec = Word SpecAs | STR SpecAs
SpecAs = as Word2 | {SPECTYPE} |
Word2 = Word | STR
Exp = default ExpDef | * ExpStar from STR SEMI | { Specs } ExpFrom SEMI | = Expr SEMI | Stmt
ExpStar = as Word |
ExpFrom = from STR |
ExpDef = function Fun | class Class | E SEMI
"""
_KEYS = "KEYS = if | else | for | while | do | return | break | continue | throw | try | catch | finally | switch | case | default | function | class | extends | import | export | from | as | of | in | instanceof | new | async | debugger | this | get | set | static"
_PLAIN = {"{TS}": "", "{TERN}": "", "{MOD}": "", "{DECL}": "", "{ITYPE}": "", "| {SPECTYPE}": ""}
_PLAIN_RULES = "TAnn = |\nRet = |\nTPar = |\nType = NEVER\nTypes = NEVER\n" + _KEYS
_TYPED = {
    "{TS}": "| interface Name TPar Heritage TBody | type TypeStmt | enum Name EnumBody | namespace Words Block | declare Stmt | abstract Stmt", "{TERN}": "| : Type", "{MOD}": "Mod", "{DECL}": "| SEMI", "{ITYPE}": "", "{SPECTYPE}": "Word SpecAs",
}
_TYPED_RULES = (
    _KEYS
    + """
Mod = Bind Mod |
Words = Word WordsMore
WordsMore = . Words |
TypeStmt = { Specs } ExpFrom SEMI | Name TypeRest
TypeRest = TPar = Type SEMI | from STR SEMI | Post Tail More SEMI
EnumBody = { Enums }
Enums = Key Init EnumMore |
EnumMore = , Enums |
TAnn = : Type | AC Type |
Ret = : Type | AC Type |
TPar = TLT TParams TGT | < TParams > |
TParams = Word TParam TMore |
TMore = , TParams |
TParam = extends Type TDef | in Type | TDef
TDef = = Type |
Types = Type TypesMore |
TypesMore = , Types |
Type = | Type2 | & Type2 | Type2
Type2 = TPrim TPost TTail
TPrim = UNARY Type2 | keyof Type2 | infer Type2 | new Type | import ( STR ) TPrimDot | this | TName TArgs | STR | NUM | TPL | PM NUM | TBody | [ TElems ] | ( TFun
TPrimDot = . Words |
TName = Word TDot
TDot = . TName |
TArgs = TLT Types TGT | < Types > |
TElems = Dots Type TElem TElemsMore |
Dots = ... |
TElem = : Type | ? TElemOpt |
TElemOpt = : Type |
TElemsMore = , TElems |
TFun = Params ) TFunRet
TFunRet = => Type | AC Type => Type |
TPost = [ TIndex ] TPost |
TIndex = Type |
TTail = | Type2 | & Type2 | extends Type2 ? Type : Type | is Type2 |
TBody = { TMembers }
TMembers = TMember TMembers |
TMember = ; | , | @ E TMember | PM TMember | ( Params ) Ret TSep | TLT TParams TGT ( Params ) Ret TSep | [ TKey | Word TRest | STR TRest | NUM TRest
TKey = E TKeyRest
TKeyRest = : Type ] TRest | ] TRest
TRest = ? TRest | PM ? TRest | : Type TSep | ( Params ) Ret TSep | TLT TParams TGT ( Params ) Ret TSep | Word TRest | [ TKey | TSep
TSep = , | SEMI
"""
)


def _script_grammar(typed: bool) -> dict:
    text = _SCRIPT
    for a, b in (_TYPED if typed else _PLAIN).items():
        text = text.replace(a, b)
    return compile_grammar(text + (_TYPED_RULES if typed else _PLAIN_RULES), "Program")


_CONTEXTUAL = ("interface", "type", "enum", "namespace", "declare", "abstract", "implements", "keyof", "is", "infer")


@cache
def _script_words(typed: bool) -> dict[str, str]:
    w = {x: x for x in (_WORDS + (" " + _TYPE_WORDS if typed else "")).split()}
    names = set(_NAMES.split()) - {"from", "as", "of", "async", "get", "set", "static", "this"}
    if typed:
        names -= set(_CONTEXTUAL)
    for x in list(w):
        if x in names:
            w[x] = "NAMEKW"
    return w | {x: "VARKW" for x in ("var", "let", "const")} | {x: "UNARY" for x in _UNARY.split()} | {"void": "VOID"}


#: After these a slash divides.
_ENDS = {"ID", "NUM", "STR", "TPL", "REGEX", ")", "]", "}", "INC", "NAMEKW", "this", "of", "from", "as", "get", "set", "static"}


def script_tokens(text: str, typed: bool) -> tuple[list[str], list[bool]]:
    words, kinds, fresh = _script_words(typed), [], []
    nl, pos, prev = False, 0, ""
    add, mark = kinds.append, fresh.append
    while pos >= 0:
        at, pos = pos, -1
        for m in _SCRIPT_TOKENS.finditer(text, at):
            g = m.lastgroup
            if g == "ID":
                k = words.get(m["ID"], "ID")
                if prev == "." or prev == "?.":
                    k = "ID"
            elif g == "NL":
                nl = True
                continue
            elif g == "OP":
                k = m["OP"]
                if k[0] == "/" and prev not in _ENDS:
                    r = _REGEX.match(text, m.start("OP"))
                    if r:
                        add("REGEX")
                        mark(nl)
                        nl, prev, pos = False, "REGEX", r.end()
                        break
                k = _KINDS.get(k, "BIN")
            elif g == "CO":
                c = m["CO"]
                nl = nl or c[1] == "*" and ("\n" in c or "\r" in c)
                continue
            elif g is None:
                continue
            else:
                k = g
            add(k)
            mark(nl)
            nl, prev = False, k
    if typed:
        _mark_words(kinds)
        if "SKIP" in kinds:
            kept = [i for i, k in enumerate(kinds) if k != "SKIP"]
            kinds, fresh = [kinds[i] for i in kept], [fresh[i] for i in kept]
        _mark_types(kinds)
    fresh.append(nl)
    return kinds, fresh


_DECLARED = {"VARKW", "function", "class", "enum", "namespace", "interface", "type", "abstract", "async", "ID"}


def _mark_words(k: list[str]) -> None:
    """Words that are reserved by what stands beside them only; elsewhere they are names."""
    for i, t in enumerate(k):
        if t not in _CONTEXTUAL:
            continue
        before, after, then = k[i - 1] if i else "", k[i + 1] if i + 1 < len(k) else "", k[i + 2] if i + 2 < len(k) else ""
        name = after in ("ID", "NAMEKW")
        if t == "type" and before in ("import", "export", "{", ",") and (after in ("{", "*") and before in ("import", "export") or name and before == "import" or name and before in ("{", ",") and then in (",", "}", "as")):
            k[i] = "SKIP"
        elif not (
            (t == "type" and name and then in ("=", "<")) or (t in ("interface", "enum") and name) or (t == "namespace" and name and then in ("{", ".")) or (t == "declare" and after in _DECLARED and before not in (".", ",", "(", "="))
            or (t == "abstract" and after == "class") or (t == "implements" and name) or (t in ("keyof", "infer") and (name or after in ("(", "UNARY", "{"))) or (t == "is" and before in ("ID", "this", "NAMEKW") and (name or after in ("{", "[", "STR", "(")))
        ):
            k[i] = "ID"


_IN_TYPE = {"ID", "VOID", "NAMEKW", "KW", ",", ".", "[", "]", "|", "&", "STR", "NUM", "{", "}", ":", ";", "(", ")", "=>", "?", "UNARY", "extends", "=", "keyof", "this", "is", "infer", "TPL"}
_AFTER_TYPE = {"(", ")", "]", ":", ";", ",", ".", "TPL", "}", "=", "=>", "|", "&", "[", "{", ">", "TGT", "?", "AC", "extends", "implements", "PRE"}


def _mark_types(k: list[str]) -> None:
    """Tell angle brackets of type arguments from comparisons, and a return type's colon from a choice's, by what follows."""
    for i, t in enumerate(k):
        prefix = t == "<" and (not i or k[i - 1] in ("=", "(", ",", "return", "=>", "?", ":", "[", "BIN", "PRE"))
        if prefix or (t == "<" and i and k[i - 1] in ("ID", "NAMEKW", "function")):
            depth, j = 1, i + 1
            while j < len(k) and depth and j - i < 200:
                if k[j] == "<":
                    depth += 1
                elif k[j] == ">":
                    depth -= 1
                elif k[j] not in _IN_TYPE:
                    break
                j += 1
            if not depth and (j == len(k) or k[j] in _AFTER_TYPE or (prefix and k[j] in ("ID", "this", "NAMEKW", "STR", "NUM", "TPL", "new"))):
                k[i], k[j - 1] = "TLT", "TGT"
        elif t == "=>":
            j, depth = i - 1, 0
            while j > 0 and i - j < 60 and (k[j] in _IN_TYPE or k[j] in ("<", ">", "TLT", "TGT")):
                if k[j] in (")", "]", "}"):
                    depth += 1
                elif k[j] in ("(", "[", "{"):
                    depth -= 1
                    if depth < 0:
                        break
                elif not depth and k[j] in (",", ";", "=", "=>"):
                    break
                elif k[j] == ":" and not depth:
                    if k[j - 1] == ")":
                        k[j] = "AC"
                    break
                j -= 1


_JAVA_TOKENS = re.compile(
    r"""\s*(?:(?P<ID>[^\W\d][\w$]*|\$[\w$]*)|(?P<CO>//[^\r\n]*|/\*[\s\S]*?\*/)|(?P<NUM>0[xXbB][\da-fA-F_]+[lL]?|(?:\d[\d_]*\.?[\d_]*|\.\d[\d_]*)(?:[eE][+-]?\d+)?[lLfFdD]?)(?![\w$])
    |(?P<STR>\"\"\"[\s\S]*?\"\"\"|"(?:[^"\\\r\n]|\\.)*")|(?P<CHR>'(?:[^'\\\r\n]|\\[^\r\n])[^'\r\n]{0,5}')
    |(?P<OP>\.\.\.|->|::|\+\+|--|==|!=|<=|&&|\|\||\+=|-=|\*=|/=|%=|&=|\|=|\^=|<<=|<<|[{}()\[\];,<>+\-*/%&|^!~?:=.@])|(?P<BAD>\S))""",
    re.X,
)
_JAVA_WORDS = "package import class interface enum record extends implements throws if else for while do return break continue throw try catch finally switch case default new instanceof assert synchronized static final public private protected abstract native transient volatile strictfp yield"
_JAVA = """
Unit = Item Unit |
Item = package Dotted ; | import IStatic Dotted ; | ; | Mods TypeDecl
IStatic = static |
Dotted = ID DottedMore | * 
DottedMore = . Dotted |
Mods = MOD Mods | static Mods | final Mods | @ Annot Mods | default Mods |
Annot = ID AnnotDot AnnotArgs | interface
AnnotDot = . ID AnnotDot |
AnnotArgs = ( AnnotIn ) |
AnnotIn = Args
TypeDecl = class ID TPar Herit ClassBody | interface ID TPar Herit ClassBody | record ID TPar ( Params ) Herit ClassBody | enum ID Herit { Enums } | ID TPar ClassBody
Herit = extends Types Herit | implements Types Herit |
TPar = TLT TPs TGT |
TPs = TP TPM
TPM = , TPs |
TP = @ Annot TP | ID TPB
TPB = extends TBs |
TBs = Type TBM
TBM = & TBs |
Types = Type MoreTypes
MoreTypes = , Types | & Types |
Type = @ Annot Type | ID TArgs TDot Dims | ? Bound
Bound = extends Type |
TArgs = TLT TypesO TGT |
TypesO = Types |
TDot = . ID TArgs TDot |
Dims = [ ] Dims |
ClassBody = { Members }
Members = Member Members |
Member = ; | Block | static Member | final Member | MOD Member | default Member | @ Annot Member | TLT TPs TGT Member | class ID TPar Herit ClassBody | interface ID TPar Herit ClassBody | enum ID Herit { Enums } | record ID RecRest | ID MRest
RecRest = ID RecIn | TLT Types TGT ( Params ) Herit ClassBody | ( Params ) Herit ClassBody
RecIn = ( Params ) Dims Throws Body | MVar | TPar ( Params ) Herit ClassBody
MRest = ( Params ) Throws Body | Block | TArgs2 MType
TArgs2 = TLT TypesO TGT |
MType = . ID MType2 | [ ] MType3 | ID MName
MType2 = TLT TypesO TGT MType | MType
MType3 = [ ] MType3 | ID MName
MName = ( Params ) Dims Throws Body | MVar
MVar = Dims Init MoreVar ;
MoreVar = , ID Dims Init MoreVar |
Init = = VInit |
VInit = { VElems } | E
VElems = VInit VMore |
VMore = , VElems |
Throws = throws Types |
Body = Block | ; | default E ;
Params = Param MoreParams |
MoreParams = , Params |
Param = final Param | @ Annot Param | Type Var ID Dims
Var = ... |
Enums = @ Annot Enums | ID EnumArgs EnumBody EnumMore | ; Members |
EnumMore = , Enums | ; Members |
EnumArgs = ( Args ) |
EnumBody = ClassBody |
Block = { Stmts }
Stmts = Stmt Stmts |
Stmt = Block | ; | if ( E ) Stmt Else | for ( For | while ( E ) Stmt | do Stmt while ( E ) ; | return OE ; | break OId ; | continue OId ; | throw E ; | try Res Block Catches Fin | switch ( E ) { Cases } SwTail | assert E AssertMsg ; | synchronized ( E ) Block | yield E ; | final Stmt | static Stmt | MOD Stmt | @ Annot Stmt | class ID TPar Herit ClassBody | interface ID TPar Herit ClassBody | enum ID Herit { Enums } | record RecStmt | E DeclOrEnd
RecStmt = ID TPar ( Params ) Herit ClassBody
SwTail = |
AssertMsg = : E |
OE = E |
OId = ID |
Else = else Stmt |
Res = ( Ress ) |
Ress = ResOne ResMore
ResMore = ; ResNext |
ResNext = Ress |
ResOne = final ResOne | E ResName
ResName = ID = E |
Catches = catch ( CatchT ) Block Catches |
CatchT = final CatchT | Type CatchOr ID
CatchOr = BIN1 Type CatchOr |
Fin = finally Block |
Cases = case CaseL CaseEnd Cases | default CaseEnd Cases |
CaseL = E CaseId CaseMore
CaseId = ID |
CaseMore = , CaseL |
CaseEnd = : Stmts | -> CaseBody
CaseBody = Block | throw E ; | E ;
For = final For | @ Annot For | ; ForCond | E ForNext
ForNext = ID ForDecl | MoreE ; ForCond
ForDecl = : E ) Stmt | Dims Init MoreVar ; ForCond
ForCond = OE ; ForUpd ) Stmt
ForUpd = E MoreE |
MoreE = , E MoreE |
DeclOrEnd = ID Dims Init MoreVar ; | : Stmt | ;
E = PM E | PRE E | INC E | P Post Tail | new Type2 NewRest Post Tail | switch ( E ) { Cases } Tail
Type2 = @ Annot Type2 | ID TArgs TDot
NewRest = ( Args ) NewBody | [ NewDim
NewBody = ClassBody |
NewDim = ] Dims { VElems } | E ] NewDims
NewDims = [ NewDimO ] NewDims |
NewDimO = E |
P = ID | NUM | STR | CHR | ( Paren | @ Annot P
Paren = Args ) Cast | final Params ) 
Cast = ID CastArgs | NUM | STR | CHR | ( Args ) Cast | new Type2 NewRest | PRE E |
CastArgs = |
Post = . Dot Post | [ Idx ] Post | ( Args ) Post | INC Post | TLT TypesO TGT Post | :: DotName Post |
Dot = ID | new Type2 NewRest | class | TLT Types TGT ID
DotName = ID | new
Idx = E |
Tail = BIN E | BIN1 E | PM E | * E | = VInit | < E | > Gt E | & E | ? E : E Tail | instanceof InstE Tail | -> Body2 |
InstE = final Type InstId | Type InstId
InstId = ID | ( Args ) |
Gt = > Gt | = |
Body2 = Block | E
Args = Arg MoreArgs |
Arg = E ArgId | final Type ID
ArgId = ID |
MoreArgs = , Args |
"""

_GO_TOKENS = re.compile(
    r"""[ \t]*(?:(?P<NL>\r?\n\s*|\r\s*)|(?P<ID>[^\W\d]\w*)|(?P<CO>//[^\r\n]*|/\*[\s\S]*?\*/)|(?P<NUM>0[xXbBoO][\da-fA-F_]+|(?:\d[\d_]*\.?[\d_]*|\.\d[\d_]*)(?:[eE][+-]?\d+)?i?)(?!\w)
    |(?P<STR>"(?:[^"\\\r\n]|\\.)*"|`[^`]*`)|(?P<CHR>'(?:[^'\\\r\n]|\\[^\r\n])[^'\r\n]{0,8}')
    |(?P<OP>\.\.\.|:=|<-|\+\+|--|==|!=|<=|>=|&&|\|\||&\^=|&\^|\+=|-=|\*=|/=|%=|&=|\|=|\^=|<<=|>>=|<<|>>|[{}()\[\];,<>+\-*/%&|^!~:=.])|(?P<BAD>[^\s]))""",
    re.X,
)
_GO_WORDS = "package import func var const type struct interface map chan if else for range return break continue goto fallthrough switch case default select go defer"
_GO_ENDS = {"ID", "NUM", "STR", "CHR", "break", "continue", "fallthrough", "return", "INC", ")", "]", "}"}
_GO = """
File = Semis package ID ; Decls
Semis = ; Semis |
Decls = Decl Decls |
Decl = ; | import Imp ; | func Func ; | var VarG ; | const VarG ; | type TypeG ;
Imp = ( Imps ) | ImpOne
Imps = ; Imps | ImpOne ImpSep |
ImpSep = ; Imps |
ImpOne = STR | ID STR | . STR
Func = Recv ID FTPar ( Params ) Results FBody
Recv = ( Params ) |
FTPar = [ Params ] |
FBody = Block |
VarG = ( Vars ) | VarOne
Vars = ; Vars | VarOne VarSep |
VarSep = ; Vars |
VarOne = ID Ids VarRest
Ids = , ID Ids |
VarRest = = Es | Type VarInit |
VarInit = = Es |
TypeG = ( Tys ) | TyOne
Tys = ; Tys | TyOne TySep |
TySep = ; Tys |
TyOne = ID TyRest
TyRest = = Type | [ TyBr | Type0
TyBr = ] Type | E TyBr2
TyBr2 = ] Type | Type TyMore ] Type | , ID TyBr2
TyMore = , ID Type TyMore | BAR Type TyMore |
Type = [ TyDim ] Type | Type0
TyDim = E | ... |
Type0 = ID TDot TArgs | * Type | map [ Type ] Type | chan ChT | ARROW chan Type | struct { Fields } | interface { Meths } | func ( Params ) Results | ( Type )
ChT = ARROW Type | Type
TDot = . ID |
TArgs = [ Types ] |
Types = Type TypesM
TypesM = , Types |
Fields = ; Fields | Field FieldSep |
FieldSep = ; Fields |
Field = * Type Tag | ID FRest
FRest = Ids Type Tag | . ID Tag | Tag
Tag = STR |
Meths = ; Meths | Meth MethSep |
MethSep = ; Meths |
Meth = TILDE Type Union | ID MethRest | * Type Union
MethRest = ( Params ) Results | TDot TArgs Union
Union = BAR UnionT Union |
UnionT = TILDE Type | Type
Params = Param ParamsM |
ParamsM = , Params |
Param = ... Type | TILDE Type Union | Type PName
PName = ... Type | Type Union | TILDE Type Union |
Results = ( Params ) | Type |
Block = { Stmts }
Stmts = ; Stmts | Stmt StmtSep |
StmtSep = ; Stmts |
Stmt = Block | var VarG | const VarG | type TypeG | if If | for For | switch Switch | select { Cases } | return OEs | break OId | continue OId | goto ID | fallthrough | go E | defer E | Simple
OEs = Es |
OId = ID |
Simple = Es SimpleRest
SimpleRest = ASG Es | DEF DefRest | = DefRest | INC | ARROW E | : Stmt0 |
Stmt0 = Stmt |
DefRest = range E | Es
If = HSimple HIf Block Else
HIf = ; HSimple |
Else = else ElseRest |
ElseRest = if If | Block
HSimple = Hs HRest | ; HSimple
HRest = ASG Hs | DEF HDef | = HDef | INC | ARROW H |
HDef = range H | Hs
For = Block | ; ForC | range H Block | Hs HRest ForNext
ForNext = ; ForC | Block
ForC = HSimpleO ; HSimpleO Block
HSimpleO = Hs HRest |
Switch = { Cases } | HSimple SwNext
SwNext = ; SwMore | { Cases }
SwMore = { Cases } | HSimple { Cases }
Cases = case CaseL : Stmts Cases | default : Stmts Cases |
CaseL = CE CaseRest CaseM
CaseM = , CaseL |
CaseRest = DEF E | = E | ARROW E |
CE = E
Es = E EsM
EsM = , Es |
E = PM E | PRE E | * E | & E | ARROW E | P Post Tail
P = ID | NUM | STR | CHR | ( ParE ) | func ( Params ) Results FLit | [ TyDim ] Type | map [ Type ] Type | chan ChT | struct { Fields } | interface { Meths }
ParE = E
FLit = Block |
Post = . DotP Post | [ Index ] Post | ( Args ) Post | { Elems } Post |
DotP = ID | ( DotT )
DotT = type | Type
Index = E IdxRest | : IdxEnd
IdxRest = : IdxEnd | , Es |
IdxEnd = E IdxE2 |
IdxE2 = : E |
Args = Arg ArgsM |
Arg = E Dots
Dots = ... |
ArgsM = , Args |
Elems = Elem ElemsM |
ElemsM = , Elems |
Elem = { Elems } KV | E KV
KV = : KVal |
KVal = { Elems } | E
Tail = BIN E | PM E | * E | & E | BAR E |
Hs = H HsM
HsM = , Hs |
H = PM H | PRE H | * H | & H | ARROW H | HP HPost HTail
HP = ID | NUM | STR | CHR | ( ParE ) | func ( Params ) Results Block | [ TyDim ] Type { Elems } | map [ Type ] Type { Elems }
HPost = . DotP HPost | [ Index ] HPost | ( Args ) HPost |
HTail = BIN H | PM H | * H | & H | BAR H |
"""

_CSS_TOKENS = re.compile(
    r"""\s*(?:(?P<CO>/\*[\s\S]*?\*/|<!--|-->)|(?P<STR>"(?:[^"\\\r\n]|\\[\s\S])*"|'(?:[^'\\\r\n]|\\[\s\S])*')|(?P<URL>url\(\s*[^"'()\s]*\s*\))|(?P<NUM>[+-]?(?:\d+\.?\d*|\.\d+)(?:[eE][+-]?\d+)?(?:%|[a-zA-Z]+)?)
    |(?P<HASH>\#[\w-]+)|(?P<AT>@[\w-]+)|(?P<ID>-?-?(?:[^\W\d]|\\.)(?:[\w-]|\\.)*|--[\w-]*)|(?P<OP>[{}()\[\];:,]|\.(?=[\w\\-])|[>+~*&|^$%!=/?]|<=?)|(?P<BAD>\S))""",
    re.X,
)
_CSS = """
Sheet = Rule Sheet |
Rule = AT AtPre AtEnd | Sel Pre { Items }
AtEnd = ; | { Items }
AtPre = Any AtPre |
Pre = Sel Pre |
Sel = ID | NUM | HASH | . | : | , | > | + | ~ | * | & | | | STR | ( In ) | [ In ]
Any = ID | NUM | HASH | . | : | , | > | + | ~ | * | & | | | STR | URL | % | = | / | ! | ? | ( In ) | [ In ]
In = InAny In |
InAny = Any | ^ | $ | < | ; | AT | { In }
Items = ; Items | Item Items |
Item = AT AtPre AtTail | ID Item1 | Sel1 Pre { Items }
AtTail = { Items } | Stop
Sel1 = NUM | HASH | . | : | > | + | ~ | * | & | ( In ) | [ In ]
Item1 = : Value | SelNext
SelNext = ID Pre { Items } | HASH Pre { Items } | . Pre { Items } | , Pre { Items } | > Pre { Items } | + Pre { Items } | ~ Pre { Items } | * Pre { Items } | ( In ) Pre { Items } | [ In ] Pre { Items } | { Items }
Value = Any Value | { Items } | Stop
Stop = ; | 
"""


_JSON_TOKENS = re.compile(r"""[ \t\n\r]*(?:(?P<STR>"(?:[^"\\\x00-\x1f]|\\(?:["\\/bfnrt]|u[0-9a-fA-F]{4}))*")|(?P<NUM>-?(?:0|[1-9][0-9]*)(?:\.[0-9]+)?(?:[eE][+-]?[0-9]+)?)|(?P<CONST>true|false|null)|(?P<OP>[\[\]{}:,])|(?P<END>\Z)|(?P<BAD>[\s\S]))""")
_JSON = """
Value = { Members } | [ Items ] | STR | NUM | CONST
Members = STR : Value MoreMembers |
MoreMembers = , STR : Value MoreMembers |
Items = Value MoreItems |
MoreItems = , Value MoreItems |
"""


def _json_kinds(text: str) -> list[str]:
    return [m["OP"] if m.lastgroup == "OP" else m.lastgroup for m in _JSON_TOKENS.finditer(text) if m.lastgroup != "END"]


@cache
def _tables() -> dict:
    return {
        "javascript": _script_grammar(False), "typescript": _script_grammar(True), "java": compile_grammar(_JAVA, "Unit"), "go": compile_grammar(_GO, "File"), "css": compile_grammar(_CSS, "Sheet"),
        "json": compile_grammar(_JSON, "Value"),
    }


def _java_kinds(text: str) -> list[str]:
    words = {x: x for x in _JAVA_WORDS.split()} | {x: "MOD" for x in "public private protected abstract native transient volatile strictfp".split()}
    ops = {c: c for c in "{}()[];,<>*?:=.@&"} | {"...": "...", "->": "->", "::": "::", "++": "INC", "--": "INC", "+": "PM", "-": "PM", "!": "PRE", "~": "PRE", "|": "BIN1"}
    k = []
    for m in _JAVA_TOKENS.finditer(text):
        g = m.lastgroup
        if g == "OP":
            k.append(ops.get(m["OP"], "BIN"))
        elif g == "ID":
            k.append(words.get(m["ID"], "ID"))
        elif g != "CO":
            k.append(g)
    for i, t in enumerate(k):
        if t == "record" and (i + 1 >= len(k) or k[i + 1] != "ID"):
            k[i] = "ID"
        elif t == "yield" and i + 1 < len(k) and k[i + 1] in (".", "=", "("):
            k[i] = "ID"
        elif t == "<":
            depth, j = 1, i + 1
            while j < len(k) and depth and j - i < 200:
                depth += (k[j] == "<") - (k[j] == ">")
                if k[j] not in ("ID", ",", ".", "?", "extends", "&", "[", "]", "<", ">", "@"):
                    break
                j += 1
            if not depth and (j == i + 2 or (j < len(k) and k[j] in ("ID", "(", ")", "[", ".", "{", ">", ",", "::", "extends", "implements", "...", "TGT", "&", ";"))) and (i == 0 or k[i - 1] in ("ID", "MOD", "static", "final", ".", "{", ";", "}", "default", "new", ")", "::")):
                k[i], k[j - 1] = "TLT", "TGT"
    return k


def _go_kinds(text: str) -> list[str]:
    words = {x: x for x in _GO_WORDS.split()}
    ops = {c: c for c in "{}()[];,*&:=."} | {"...": "...", ":=": "DEF", "<-": "ARROW", "++": "INC", "--": "INC", "+": "PM", "-": "PM", "^": "PM", "!": "PRE", "|": "BAR", "~": "TILDE"}
    ops |= {x: "ASG" for x in "+= -= *= /= %= &= |= ^= <<= >>= &^=".split()}
    k: list[str] = []
    for m in _GO_TOKENS.finditer(text):
        g = m.lastgroup
        if g == "OP":
            k.append(ops.get(m["OP"], "BIN"))
        elif g == "ID":
            k.append(words.get(m["ID"], "ID"))
        elif g == "NL":
            if k and k[-1] in _GO_ENDS:
                k.append(";")
        elif g == "CO":
            if m["CO"][1] == "*" and "\n" in m["CO"] and k and k[-1] in _GO_ENDS:
                k.append(";")
        else:
            k.append(g)
    if k and k[-1] in _GO_ENDS:
        k.append(";")
    out: list[str] = []
    for i, t in enumerate(k):  # a separator before a closing bracket may be left out
        if t == ";" and i + 1 < len(k) and k[i + 1] == ")" and i and k[i - 1] == ",":
            continue
        out.append(t)
    return out


def _css_kinds(text: str) -> list[str]:
    return [m["OP"] if m.lastgroup == "OP" else m.lastgroup for m in _CSS_TOKENS.finditer(text) if m.lastgroup != "CO"]


_ELEMENT = re.compile(r"(?:(?:^|[=(,?:&|;{}\[>])\s*|\b(?:return|default)\s+|\breturn\s*)(<)(?=[A-Za-z_$>])")
_TAG = re.compile(r"[A-Za-z_$][\w$.:-]*")
_ATTRIBUTE = re.compile(r"[A-Za-z_$][\w$:.-]*")
_QUOTED = re.compile(r"\"(?:[^\"\\\n]|\\.)*\"|'(?:[^'\\\n]|\\.)*'|`(?:[^`\\]|\\.)*`|//[^\n]*|/\*[\s\S]*?\*/")


class _NoElement(Exception):
    pass


def _braces(t: str, i: int) -> int:
    """Past the brace that closes the one at i; quotes and comments count as one."""
    depth = 0
    while i < len(t):
        c = t[i]
        if c in "\"'`/" and (m := _QUOTED.match(t, i)):
            i = m.end()
            continue
        depth += (c == "{") - (c == "}")
        i += 1
        if not depth:
            return i
    raise _NoElement


def _element(t: str, i: int, inner: list[str]) -> int:
    """Past the element at i; the expressions in it are collected."""
    work: list[str] = []
    while True:
        tag = _TAG.match(t, i + 1)
        name = tag.group() if tag else ""
        i = tag.end() if tag else i + 1
        alone = False
        while True:
            while i < len(t) and t[i].isspace():
                i += 1
            if t.startswith("/>", i):
                alone, i = True, i + 2
                break
            if t.startswith(">", i):
                i += 1
                break
            if t.startswith("{", i):
                end = _braces(t, i)
                inner.append(t[i + 1 : end - 1].strip().removeprefix("..."))
            elif m := _ATTRIBUTE.match(t, i):
                end = m.end()
                if t.startswith("=", end):
                    end += 1
                    if t.startswith("{", end):
                        start, end = end, _braces(t, end)
                        inner.append(t[start + 1 : end - 1])
                    elif q := re.compile(r"\"[^\"]*\"|'[^']*'").match(t, end):
                        end = q.end()
                    else:
                        raise _NoElement
            else:
                raise _NoElement
            i = end
        if not alone:
            work.append(name)
        while work:
            i = min((x for x in (t.find("<", i), t.find("{", i)) if x >= 0), default=-1)
            if i < 0:
                raise _NoElement
            if t[i] == "{":
                end = _braces(t, i)
                inner.append(t[i + 1 : end - 1].strip().removeprefix("..."))
                i = end
            elif t.startswith("</", i):
                m = re.compile(r"</\s*([\w$.:-]*)\s*>").match(t, i)
                if not m or m[1] != work.pop():
                    raise _NoElement
                i = m.end()
            else:
                break
        if not work:
            return i


def without_elements(text: str) -> str:
    """A script with each JSX element replaced by its expressions in brackets; what isn't a whole element stays."""
    if "</" not in text and "/>" not in text:
        return text
    out, at = [], 0
    while m := _ELEMENT.search(text, at):
        i, inner = m.start(1), []
        try:
            end = _element(text, i, inner)
        except _NoElement:
            out.append(text[at : i + 1])
            at = i + 1
            continue
        parts = [without_elements(f"({x})")[1:-1] for x in inner if _QUOTED.sub("", x).strip()]
        out.append(f"{text[at:i]}({', '.join(['0', *[f'({x})' for x in parts]])})")
        at = end
        if text[at : at + 1] == "<":
            out.append(" ")
    return "".join([*out, text[at:]])


_DEEP = ("too many levels of indentation", "too many nested", "too many statically nested")


def _python_error(text: str) -> str | None:
    with warnings.catch_warnings():
        warnings.simplefilter("ignore")
        try:
            ast.parse(text)
        except SyntaxError as e:
            return None if any(x in str(e.msg) for x in _DEEP) else f"{e.lineno or 0}: {e.msg}"
        except (ValueError, UnicodeError) as e:
            return f"0: {e}"
        except (RecursionError, MemoryError):
            return None
    return None


LANGUAGES = ("python", "javascript", "typescript", "tsx", "java", "go", "css", "json")


def first_problem(language: str, text: str) -> str | None:
    """The first unrecoverable error of a text in its language, None if it parses; blank texts parse.

    Python is parsed by the interpreter's own generated parser (its limits on depth are no errors), all others by the tables above,
    whatever their depth.
    """
    text = text.removeprefix("﻿")
    if not text.strip():
        return None
    if language == "python":
        return _python_error(text)
    tables = _tables()
    fresh = None
    if language in ("javascript", "typescript", "tsx"):
        if text.startswith("#!"):
            text = "//" + text
        typed = language != "javascript"
        if language != "typescript":
            text = without_elements(text)
        kinds, fresh = script_tokens(text, typed)
        table = tables["typescript" if typed else "javascript"]
    elif language == "java":
        kinds, table = _java_kinds(text), tables["java"]
    elif language == "go":
        kinds, table = _go_kinds(text), tables["go"]
    elif language == "css":
        kinds, table = _css_kinds(text), tables["css"]
    elif language == "json":
        kinds, table = _json_kinds(text), tables["json"]
    else:
        return None
    at = first_error(table, kinds, fresh)
    return None if at < 0 else f"token {at}: {kinds[at] if at < len(kinds) else 'end of file'}"
