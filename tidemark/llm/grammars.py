"""Grammars of the checked languages, for parsing with derivatives.

They tell whether a text is well formed, not what it means: precedence of operators is left out
and unknown names or types do not matter.
"""

from __future__ import annotations

from .derivatives import Grammar
from .lexers import SQL_WORDS, TS_WORDS

JSON = """
value = '{' (pair (',' pair)*)? '}' | '[' (value (',' value)*)? ']' | STR | NUM | 'true' | 'false' | 'null' ;
pair = STR ':' value ;
"""

XML = """
document = DECL? misc* (DOCTYPE misc*)? element misc* ;
misc = WS | PI | COMMENT ;
content = (element | TEXT | WS | PI | COMMENT | CDATA)* ;
"""


def _element(g: Grammar, t: str) -> list[tuple[int, ...]]:
    """An element is an empty tag, or an opening tag, content and the closing tag of its name."""
    if t == "EMPTY":
        return [()]
    if t.startswith("<") and not t.startswith("</"):
        return [(g.node(("rule", "content")), g.token("</" + t[1:]))]
    return []


JAVA = """
unit = annotation* ('package' qname ';')? (import | ';')* (mods typedecl | ';' | method_top)* module? ;
module = annotation* id? id qname '{' (id+ (qname | id | ',' | 'static' | '.')* ';')* '}' ;
method_top = mods methodlike ;
import = 'import' 'static'? qname ('.' '*')? ';' ;
qname = id ('.' id)* ;
id = ID | 'record' | 'var' | 'yield' | 'sealed' | 'permits' | 'non' | 'when' ;
annotation = '@' qname ('(' (annvalue (',' annvalue)*)? ')')? ;
annvalue = (id '=')? annelem ;
annelem = expr | annotation | '{' (annelem (',' annelem)*)? ','? '}' ;
mods = (annotation | 'public' | 'protected' | 'private' | 'static' | 'abstract' | 'final' | 'native' | 'synchronized' | 'transient' | 'volatile' | 'strictfp' | 'default' | 'sealed' | 'non' '-' 'sealed')* ;
typedecl = class | interface | enum | record | anndecl ;
class = 'class' id tparams? ('extends' type)? ('implements' types)? ('permits' types)? body ;
interface = 'interface' id tparams? ('extends' types)? ('permits' types)? body ;
enum = 'enum' id ('implements' types)? '{' (enumconst (',' enumconst)* ','? | ',')? (';' member*)? '}' ;
enumconst = annotation* id args? body? ;
record = 'record' id tparams? '(' params? ')' ('implements' types)? body ;
anndecl = '@' 'interface' id body ;
tparams = '<' tparam (',' tparam)* '>' ;
tparam = annotation* id ('extends' type ('&' type)*)? ;
types = type (',' type)* ;
type = annotation* (prim | cname) dims ;
prim = 'boolean' | 'byte' | 'short' | 'int' | 'long' | 'char' | 'float' | 'double' ;
cname = id targs? ('.' annotation* id targs?)* ;
targs = '<' (targ (',' targ)*)? '>' ;
targ = annotation* '?' (('extends' | 'super') type)? | type ;
dims = (annotation* '[' ']')* ;
body = '{' member* '}' ;
member = ';' | 'static'? block | mods (typedecl | methodlike | type vardecls ';') ;
methodlike = tparams? ((type | 'void') id '(' params? ')' dims | id '(' params? ')') ('throws' types)? (block | ('default' annelem)? ';') | id block ;
params = param (',' param)* ;
param = (annotation | 'final')* type ('...')? (id dims | (id '.')? 'this') ;
vardecls = vardecl (',' vardecl)* ;
vardecl = id dims ('=' init)? ;
init = expr | '{' (init (',' init)*)? ','? '}' ;
block = '{' stmt* '}' ;
stmt = block | ';' | localvar ';' | mods typedecl | 'if' '(' expr ')' stmt ('else' stmt)? | 'while' '(' expr ')' stmt | 'do' stmt 'while' '(' expr ')' ';'
  | 'for' '(' (localvar | exprs)? ';' expr? ';' exprs? ')' stmt | 'for' '(' (annotation | 'final')* type id dims ':' expr ')' stmt
  | 'switch' '(' expr ')' switchbody | 'return' expr? ';' | 'break' id? ';' | 'continue' id? ';' | 'throw' expr ';' | 'yield' expr ';' | 'assert' expr (':' expr)? ';'
  | 'synchronized' '(' expr ')' block | 'try' ('(' resource (';' resource)* ';'? ')')? block catch* ('finally' block)? | id ':' stmt | action ';' ;
catch = 'catch' '(' (annotation | 'final')* type ('|' type)* id ')' block ;
resource = (annotation | 'final')* type id '=' expr | expr ;
localvar = (annotation | 'final')* type vardecls ;
action = ('++' | '--') unary | primary suffix* ('.' targs? (id | 'super') args | '++' | '--' | assign expr) | (id | 'this' | 'super') args | targs ('this' | 'super') args | 'new' creator ;
exprs = expr (',' expr)* ;
assign = '=' | '+=' | '-=' | '*=' | '/=' | '%=' | '&=' | '|=' | '^=' | '<<=' | '>>=' | '>>>=' | '>' '>=' | '>' '>' '>=' ;
expr = lambda | operation ('?' expr ':' expr)? (assign expr)? ;
operation = unary (binop (unary | lambda) | 'instanceof' 'final'? pattern)* ;
binop = '||' | '&&' | '|' | '&' | '^' | '==' | '!=' | '<' | '>' | '<=' | '>=' | '<<' | '>' '>' | '>' '>' '>' | '+' | '-' | '*' | '/' | '%' ;
pattern = (annotation | 'final')* type (id | '(' (pattern (',' pattern)*)? ')' id?)? ;
unary = ('+' | '-' | '!' | '~' | '++' | '--' | '(' type ('&' type)* ')')* (primary suffix* | lambda) ;
primary = STR | CHAR | NUM | 'true' | 'false' | 'null' | (id | 'this' | 'super') args? | '(' expr ')' | 'new' creator | prim dims '.' 'class' | id ('.' id)* '[' ']' dims '.' 'class' | 'void' '.' 'class'
  | type '::' (id | 'new') | 'switch' '(' expr ')' switchbody | targs ('this' | 'super') args ;
suffix = '.' (targs? id args? | 'class' | 'this' | targs? 'super' args? | 'new' creator) | '[' expr ']' | '++' | '--' | '::' targs? (id | 'new') ;
args = '(' (expr (',' expr)*)? ')' ;
creator = targs? annotation* (prim | cname) (args body? | (annotation* '[' expr ']')+ dims | '[' ']' dims '{' (init (',' init)*)? ','? '}') ;
lambda = (id | '(' (lparam (',' lparam)*)? ')') '->' (expr | block) ;
lparam = id | param ;
switchbody = '{' (label+ stmt*)* '}' | '{' (arrowlabel '->' (expr ';' | block | 'throw' expr ';'))* '}' ;
label = caselabel ':' ;
arrowlabel = caselabel ;
caselabel = 'case' caseitem (',' caseitem)* ('when' expr)? | 'default' ;
caseitem = operation ('?' expr ':' expr)? | pattern | 'default' ;
"""

_TS_RESERVED = frozenset("break case catch class const continue debugger default delete do else enum export extends false finally for function if import in instanceof new null return super switch this throw true try typeof var void while with".split())

TS = """
program = item* ;
item = stmt | import | export ;
import = 'import' STR withs? ';' | 'import' 'type'? (id (',' (named | '*' 'as' id))? | named | '*' 'as' id) 'from' STR withs? ';' | 'import' 'type'? id '=' (expr) ';' ;
withs = ('with' | 'assert') object ;
named = '{' (spec (',' spec)*)? ','? '}' ;
spec = 'type'? (name | STR) ('as' (name | STR))? ;
export = 'export' (decl | 'default' (expr ';' | 'async'? function | 'abstract'? class | interface) | 'type'? named ('from' STR withs?)? ';' | 'type'? '*' ('as' name)? 'from' STR withs? ';' | '=' expr ';' | 'import' id '=' expr ';' | 'as' 'namespace' id ';') ;
decl = decorator* ('const' | 'let' | 'var') bindings ';' | 'const'? 'enum' id '{' (enummember (',' enummember)*)? ','? '}' | 'async'? function | decorator* 'abstract'? class | interface | typealias | 'declare' declared | ('namespace' | 'module') (id ('.' id)* | STR) block ;
declared = decl | 'global' block | 'function' id? signature ';' | ('module') STR ';' ;
enummember = (name | STR) ('=' expr)? ;
typealias = 'type' id tparams? '=' type ';' ;
interface = 'interface' id tparams? ('extends' heritage (',' heritage)*)? objecttype ;
heritage = name ('.' name)* targs? ;
function = 'function' '*'? id? signature (block | ';') ;
signature = tparams? '(' params? ')' (':' returntype)? ;
returntype = type | 'asserts' (id | 'this') ('is' type)? | (id | 'this') 'is' type ;
params = param (',' param)* ','? ;
param = decorator* ('public' | 'private' | 'protected' | 'readonly' | 'override')* '...'? (binding | 'this') '?'? (':' type)? ('=' expr)? ;
binding = id | '{' (bindprop (',' bindprop)*)? ','? '}' | '[' (bindelem? (',' bindelem?)*) ']' ;
bindprop = '...' id | propname ':' binding ('=' expr)? | id ('=' expr)? ;
bindelem = '...' binding | binding ('=' expr)? ;
bindings = bindone (',' bindone)* ;
bindone = binding '!'? (':' type)? ('=' expr)? ;
class = 'class' id? tparams? ('extends' postfix targs?)? ('implements' heritage (',' heritage)*)? '{' classmember* '}' ;
classmember = ';' | 'static' block | decorator* memberword* (propname ('?' | '!')? ((':' type)? ('=' expr)? ';' | signature (block | ';')) | '*' propname signature block | ('get' | 'set') propname signature (block | ';') | '[' id ':' type ']' ':' type ';') ;
memberword = 'public' | 'private' | 'protected' | 'static' | 'abstract' | 'readonly' | 'async' | 'declare' | 'override' | 'accessor' ;
decorator = '@' postfix ;
block = '{' item* '}' ;
stmt = block | ';' | decl | 'if' '(' exprs ')' stmt ('else' stmt)? | 'for' 'await'? '(' forhead ')' stmt | 'while' '(' exprs ')' stmt | 'do' stmt 'while' '(' exprs ')' ';'? | 'return' exprs? ';' | 'break' id? ';' | 'continue' id? ';'
  | 'throw' exprs ';' | 'try' block ('catch' ('(' binding (':' type)? ')')? block)? ('finally' block)? | 'switch' '(' exprs ')' '{' (('case' exprs | 'default') ':' item*)* '}' | 'debugger' ';' | id ':' stmt | exprs ';' ;
forhead = (('const' | 'let' | 'var') bindings | exprs)? ';' exprs? ';' exprs? | ('const' | 'let' | 'var') binding ('of' | 'in') exprs | postfix ('of' | 'in') exprs ;
exprs = expr (',' expr)* ;
expr = 'yield' '*'? expr? | arrow | operation ('?' expr ':' expr)? (assign expr)? ;
assign = '=' | '+=' | '-=' | '*=' | '/=' | '%=' | '&=' | '|=' | '^=' | '<<=' | '>>=' | '>>>=' | '**=' | '&&=' | '||=' | '??=' | '>' '>=' | '>' '>' '>=' ;
arrow = 'async'? (id | tparams? '(' params? ')' (':' returntype)?) '=>' (expr | block) ;
operation = unary (binop unary | ('as' | 'satisfies') ('const' | type))* ;
binop = '||' | '&&' | '??' | '|' | '&' | '^' | '==' | '!=' | '===' | '!==' | '<' | '>' | '<=' | '>=' | '<<' | '>' '>' | '>' '>' '>' | '+' | '-' | '*' | '/' | '%' | '**' | 'in' | 'instanceof' ;
unary = ('+' | '-' | '!' | '~' | '++' | '--' | 'typeof' | 'void' | 'delete' | 'await' | '<' type '>')* (postfix ('++' | '--')? | arrow) ;
postfix = primary suffix* ;
suffix = ('.' | '?.') name | '?.'? '[' exprs ']' | '?.'? targs? args | '!' | template ;
args = '(' (arg (',' arg)* ','?)? ')' ;
arg = '...'? expr ;
primary = id | 'this' | 'super' | STR | NUM | REGEX | template | 'null' | 'true' | 'false' | '(' exprs ')' | array | object | 'async'? function_expr | class | 'new' newtarget | 'import' args | 'import' '.' name ;
newtarget = '.' name | ('new' newtarget | primary) ('.' name | '[' exprs ']' | '!')* targs? args? ;
function_expr = 'function' '*'? id? signature block ;
array = '[' (arg? (',' arg?)*) ']' ;
object = '{' (prop (',' prop)*)? ','? '}' ;
prop = '...' expr | propname ':' expr | id ('=' expr)? | 'async'? '*'? propname signature block | ('get' | 'set') propname signature block ;
propname = name | STR | NUM | '[' expr ']' ;
template = TPL | TPL_HEAD exprs (TPL_MIDDLE exprs)* TPL_TAIL ;
tparams = '<' tparam (',' tparam)* ','? '>' ;
tparam = ('const' | 'in' | 'out')* id ('extends' type)? ('=' type)? ;
targs = '<' type (',' type)* '>' ;
type = 'abstract'? 'new'? tparams? '(' params? ')' '=>' returntype | union ('extends' union '?' type ':' type)? ;
union = '|'? inter ('|' inter)* ;
inter = '&'? unarytype ('&' unarytype)* ;
unarytype = ('keyof' | 'unique' | 'readonly')* ('infer' id ('extends' unarytype)? | posttype) ;
posttype = primtype ('[' type? ']')* ;
primtype = STR | '-'? NUM | 'true' | 'false' | 'null' | 'void' | 'this' | TPL | TPL_HEAD type (TPL_MIDDLE type)* TPL_TAIL | id ('.' name)* targs? | '(' type ')' | '[' (tupleelem (',' tupleelem)*)? ','? ']' | objecttype | 'typeof' (id | 'this' | 'import' '(' type ')') ('.' name)* targs? | 'import' '(' type (',' object)? ')' ('.' name)* targs? ;
tupleelem = '...'? (name '?'? ':')? type '?'? ;
objecttype = '{' (typemember ((';' | ',') typemember)*)? (';' | ',')? '}' | '{' ('+' | '-')? 'readonly'? '[' id 'in' type ('as' type)? ']' (('+' | '-')? '?')? (':' type)? (';' | ',')? '}' ;
typemember = 'new'? signature | 'readonly'? propname '?'? (':' type)? | ('get' | 'set')? propname '?'? signature | 'readonly'? '[' id ':' type ']' ':' type ;
""" + f"""
id = ID | {' | '.join(repr(w) for w in sorted(TS_WORDS - _TS_RESERVED))} ;
name = ID | {' | '.join(repr(w) for w in sorted(TS_WORDS))} ;
"""

_SQL_RESERVED = frozenset(
    "all and any array as asc case cast check collate constraint create cross default desc distinct do else end except false fetch for foreign from full grant group having in inner intersect into is join lateral left like ilike similar limit natural not null offset on only or order"
    " column outer primary references returning right select some table then to true union unique user using when where window with isnull notnull".split()
)

SQL = """
script = (statement? ';')* statement? ;
statement = query | insert | update | delete | create | alter | drop | comment | do | other ;
do = 'do' ('language' id)? (BODY | STR) ('language' id)? ;
other = verb run? | grant | revoke | set | truncate | copy | ('begin' | 'end' | 'commit' | 'rollback' | 'start') id* (ID | ',' | 'to')* | 'import' 'foreign' 'schema' run | 'explain' ('(' run? ')' | ID | 'analyze')* (query | insert | update | delete) | with? 'merge' 'into' run ;
verb = 'abort' | 'analyze' | 'call' | 'checkpoint' | 'close' | 'cluster' | 'commit' | 'deallocate' | 'declare' | 'discard' | 'execute' | 'fetch' | 'listen' | 'load' | 'lock' | 'move' | 'notify' | 'prepare' | 'reassign' | 'refresh' | 'reindex' | 'release'
  | 'reset' | 'rollback' | 'savepoint' | 'security' | 'show' | 'unlisten' | 'vacuum' ;
grant = 'grant' (privileges 'on' granted | names) 'to' grantees ('with' ('grant' id | grantoption (',' grantoption)*))? (ID 'by' name)? ;
revoke = 'revoke' (('grant' | 'set' | name) id 'for')? (privileges 'on' granted | names) 'from' grantees (ID 'by' name)? ('cascade' | 'restrict')? ;
grantoption = (id | 'set') (id | 'true' | 'false') ;
privileges = privilege (',' privilege)* ;
privilege = ('select' | 'references' | 'create' | 'all' ID? | 'alter' name | name) ('(' names ')')? ;
granted = ('table' | 'foreign' ID ID? | 'sequence' | 'schema' | 'language' | 'type' | 'function' | 'procedure' | ID)? signature (',' signature)* | 'all' id 'in' 'schema' names | ID ID NUM (',' NUM)* ;
signature = qname ('(' run? ')')? ;
grantees = 'group'? name (',' 'group'? name)* ;
set = 'set' ID? qname ('to' | '=') (setword (',' setword)*) | 'set' name setword+ (',' setword+)* ;
setword = name | 'on' | 'true' | 'false' | 'default' | 'all' | 'only' | 'not' | 'as' | STR | ('-' | '+')? NUM | PARAM | 'interval' STR ;
truncate = 'truncate' 'table'? 'only'? qname '*'? (',' 'only'? qname '*'?)* (ID 'identity')? ('cascade' | 'restrict')? ;
copy = 'copy' (qname ('(' names ')')? ('from' | 'to') | '(' (query | insert | update | delete) ')' 'to') (STR | ID STR?) 'with'? ('(' run ')' | (ID | 'null' | 'not' | 'as' | STR | '*' | qname (',' qname)*)*) ('where' expr)? ;
run = part (',' part)* ;
part = (joint* piece)+ ;
piece = word | STR | NUM | BODY | PARAM | '*' | '[' run? (':' run?)? ']' | '(' run? ')' ;
joint = oper | '.' | ':' | ':=' | '::' ;
loose = word | STR | NUM | BODY | PARAM | oper | '.' | ',' | ':' | ':=' | '::' | '[' loose* ']' | '(' loose* ')' ;
oper = '=' | '*' | '<' | '>' | '-' | '+' | OP ;
qname = name ('.' (name | '*'))* ;
query = with? setquery ('order' 'by' sortlist)? (limit)* ('for' ('update' | id | 'key' | 'no')+ ('of' qname (',' qname)*)? (id id?)?)* ;
with = 'with' 'recursive'? cte (',' cte)* ;
cte = name ('(' names ')')? 'as' ('not'? 'materialized')? '(' (query | insert | update | delete) ')' ;
names = name (',' name)* ;
limit = 'limit' (expr | 'all') | 'offset' expr ('row' | 'rows')? | 'fetch' ('first' | 'next_' | id) expr? ('row' | 'rows') ('only' | 'with' id) ;
setquery = queryterm (('union' | 'intersect' | 'except') ('all' | 'distinct')? queryterm)* ;
queryterm = '(' query ')' | select | 'values' rowlist | 'table' qname ;
rowlist = '(' valuelist ')' (',' '(' valuelist ')')* ;
valuelist = value (',' value)* ;
value = expr | 'default' ;
select = 'select' ('all' | 'distinct' ('on' '(' exprs ')')?)? (selectitem (',' selectitem)*)? ('into' ('temp' | 'temporary' | 'unlogged')? 'table'? qname (',' qname)*)? ('from' fromitem (',' fromitem)*)? ('where' expr)? ('group' 'by' ('all' | 'distinct')? groupitem (',' groupitem)*)? ('having' expr)? ('window' name 'as' windowdef (',' name 'as' windowdef)*)? ;
groupitem = expr | '(' ')' ;
selectitem = '*' | expr (('as' anyname) | name)? ;
anyname = ID | STR_ | word ;
fromitem = fromone (join)* ;
join = ('cross' | 'natural' (('left' | 'right' | 'full') 'outer'? | 'inner')?) 'join' fromone | (('left' | 'right' | 'full') 'outer'? | 'inner')? 'join' fromitem ('on' expr | 'using' '(' names ')') ;
fromone = 'only'? 'lateral'? (qname '*'? ('(' funcargs? ')' ('with' id)?)? | '(' query ')' | '(' fromitem ')') ('as'? name ('(' coldefs ')')?)? ('as' '(' coldefs ')')? ;
coldefs = name type? (',' name type?)* ;
sortlist = sortitem (',' sortitem)* ;
sortitem = expr ('asc' | 'desc' | 'using' oper)? ('nulls' ('first' | 'last')) ? ;
insert = with? 'insert' 'into' qname ('as' name)? ('(' qname (',' qname)* ')')? ('default' 'values' | query) ('on' 'conflict' ('(' exprs ')' ('where' expr)? | 'on' 'constraint' name)? 'do' ('nothing' | 'update' 'set' setlist ('where' expr)?))? returning? ;
returning = ('returning') selectitem (',' selectitem)* ('into' qname (',' qname)*)? ;
update = with? 'update' 'only'? qname ('as'? name)? 'set' setlist ('from' fromitem (',' fromitem)*)? ('where' expr)? returning? ;
setlist = setone (',' setone)* ;
setone = qname ('[' expr ']')* '=' value | '(' names ')' '=' ('row'? '(' valuelist ')' | '(' query ')') ;
delete = with? 'delete' 'from' 'only'? qname ('as'? name)? ('using' fromitem (',' fromitem)*)? ('where' expr)? returning? ;
comment = 'comment' 'on' ('column' | 'table' | 'function' | 'view' | 'type' | 'schema' | 'sequence' | 'index' | 'trigger' | 'constraint' | 'role' | 'extension' | 'materialized' | id)+ qname ('(' run? ')')? ('on' qname)? 'is' (STR | 'null') ;
drop = 'drop' ('table' | 'materialized'? 'view' | 'index' ID? | 'sequence' | 'schema' | 'type' | 'function' | 'procedure' | 'extension' | 'role' | 'user' | 'group' | ID? 'language' | 'foreign' 'table') ('if' 'exists')? signature (',' signature)* ('cascade' | 'restrict')?
  | 'drop' 'trigger' ('if' 'exists')? name 'on' qname ('cascade' | 'restrict')? | 'drop' 'foreign' ID ID ('if' 'exists')? names ('cascade' | 'restrict')? | 'drop' 'cast' ('if' 'exists')? '(' type 'as' type ')' ('cascade' | 'restrict')? | 'drop' 'user' KIND ('if' 'exists')? 'for' run | 'drop' KIND run | 'drop' OPERATOR loose+ ;
alter = 'alter' 'table' ('if' 'exists')? 'only'? qname '*'? alteraction (',' alteraction)* | 'alter' 'table' 'all' 'in' run | 'alter' 'foreign' 'table' ('if' 'exists')? 'only'? qname '*'? alteraction (',' alteraction)* | 'alter' ('user' | 'role' | 'group') (name | 'all') roleoption+ | 'alter' 'user' KIND 'for' run
  | 'alter' 'default' ID ('for' ('role' | 'user') names)? ('in' 'schema' names)? (grant | revoke) | 'alter' ('extension' | 'foreign' ID ID | 'function' | 'procedure' | 'index' | ID? 'language' | 'materialized' 'view' | 'schema' | 'sequence' | 'trigger' | 'type' | 'view' | KIND) run | 'alter' OPERATOR loose+ ;
alteraction = 'add' 'column'? ('if' 'not' 'exists')? column | 'add' tableconstraint ('not' id)? | 'add' ('constraint' name)? ('primary' 'key' | 'unique') 'using' 'index' name attribute* | 'drop' 'column'? ('if' 'exists')? name ('cascade' | 'restrict')? | 'drop' 'constraint' ('if' 'exists')? name ('cascade' | 'restrict')? | 'alter' ('column' | 'constraint')? name part | (ID | 'set' | 'reset' | 'inherit' | 'no' | 'not' | 'cluster') part ;
roleoption = 'with' | 'inherit' | 'password' (STR | 'null') | 'in'? ('role' | 'group' | 'user') names | 'in' ID name | ID (STR | NUM | '-' NUM)? | ID 'limit' '-'? NUM | ID 'to' name | ('add' | 'drop') 'user' names | 'no' id | set | 'set' name 'from' 'current' | 'reset' (qname | 'all') ;
create = 'create' ('or' 'replace')? (createtable | createview | createfunction | createindex | createrole | createtrigger | createseq | createtype | 'schema' ('if' 'not' 'exists')? run | 'extension' run | 'cast' run | 'default'? KIND run | 'foreign' (ID ID | 'table') run | 'user' KIND ('if' 'not' 'exists')? 'for' run | KIND? 'language' run | OPERATOR loose+) ;
createtable = (SCOPE? ('temp' | 'temporary') | 'unlogged')? 'table' ('if' 'not' 'exists')? qname (('of' qname)? '(' (tableitem (',' tableitem)*)? ')' | ('(' names ')')? 'as' query | 'partition' 'of' qname ('for' 'values' part | 'default')) (id '(' names ')')? ('partition' 'by' part)? ('with' '(' run? ')')? ('as' query)? ('on' id part)? (ID name)? ;
tableitem = column | tableconstraint | 'like' qname part? ;
column = name type columnconstraint* ;
columnconstraint = ('constraint' name)? ('not' 'null' | 'null' | 'default' bexpr | 'primary' 'key' | 'unique' ('nulls' 'not'? 'distinct')? | 'check' '(' expr ')' | 'references' qname ('(' names ')')? refaction* | 'generated' ('always' | 'by' 'default') 'as' ('identity' ('(' run? ')')? | '(' expr ')' 'stored') | 'collate' qname | attribute | 'compression' id | 'storage' id) ;
attribute = 'not'? 'deferrable' | 'initially' ('deferred' | 'immediate') | 'no' 'inherit' ;
refaction = 'on' ('delete' | 'update') ('set' ('null' | 'default') ('(' names ')')? | 'no' 'action' | 'restrict' | 'cascade') | 'match' id ;
tableconstraint = ('constraint' name)? ('primary' 'key' '(' names ')' | 'unique' ('nulls' 'not'? 'distinct')? '(' names ')' | 'check' '(' expr ')' | 'foreign' 'key' '(' names ')' 'references' qname ('(' names ')')? refaction* | 'exclude' ('using' name)? '(' excluded (',' excluded)* ')' ('where' '(' expr ')')?) attribute* ;
excluded = indexitem 'with' (oper | ID '(' (id '.')* oper ')') ;
createview = ('temp' | 'temporary' | 'recursive' | 'materialized')* 'view' ('if' 'not' 'exists')? qname ('(' names ')')? ('with' '(' run? ')')? 'as' query ('with' (ID | 'no' | 'check' | word)+)? ;
createindex = 'unique'? 'index' (ID)? ('if' 'not' 'exists')? qname? 'on' 'only'? qname ('using' name)? '(' indexitem (',' indexitem)* ')' (ID '(' names ')')? ('with' '(' run? ')')? ('where' expr)? ;
indexitem = expr ('collate' qname)? ID? ('asc' | 'desc')? ('nulls' ('first' | 'last'))? ;
createrole = ('role' | 'user' | 'group') name roleoption* ;
createseq = ('temp' | 'temporary')? 'sequence' ('if' 'not' 'exists')? qname run? ;
createtype = 'type' qname ('as' ('(' coldefs ')' | ID '(' (STR (',' STR)*)? ')' | 'range' '(' run? ')'))? ;
createtrigger = 'constraint'? 'trigger' name id event ('or' event)* 'on' qname ('from' qname)? (ID | 'not' ID)* ('references' part)? ('for' 'each_'? id? ('row' | id))? ('when' '(' expr ')')? 'execute_'? id? ('procedure' | 'function') qname '(' (expr (',' expr)*)? ')' ;
event = 'insert' | 'delete' | 'update' ('of' names)? | ID ;
createfunction = ('function' | 'procedure') qname '(' (funcparam (',' funcparam)*)? ')' ('returns' ('table' '(' coldefs ')' | 'null' 'on' 'null' ID | type))? funcoption+ ;
funcparam = ('in' | ID)? name? type (('default' | '=' | ':=') expr)? ;
funcoption = 'language' (name | STR) | 'as' (BODY | STR) (',' STR)? | ID (NUM | ID)* | 'not' ID | 'returns' 'null' 'on' 'null' 'input_'? ID? | 'set' name ('to' | '=' | 'from') (value (',' value)*| 'current') | 'window' | 'return' expr ;
type = 'setof_'? (ID 'of')? typename ('(' (expr (',' expr)*)? ')')? (ID)* ('with' id id 'zone_'? | 'with' id id)? ('[' NUM? ']')* ('array' ('[' NUM ']')?)? ;
typename = name ('.' name)* | 'interval' ;
exprs = expr (',' expr)* ;
bexpr = atom (oper atom | '::' type)* ;
expr = notexpr (('and' | 'or') notexpr)* ;
notexpr = 'not'* comparison ;
comparison = atom tail* ;
tail = oper ('any' | 'all' | 'some') '(' (query | expr) ')' | oper atom | '::' type | 'collate' qname | 'is' 'not'? ('null' | 'true' | 'false' | ID | 'distinct' 'from' atom) | 'isnull' | 'notnull' | 'not'? 'in' '(' (query | exprs) ')' | 'not'? 'between' ID? betweenatom 'and' betweenatom | 'not'? ('like' | 'ilike' | 'similar' 'to') atom ('escape' atom)? | 'at_' | ID 'time_' ID atom | ID ID ID atom ;
betweenatom = atom (oper atom | '::' type)* ;
atom = ('-' | '+' | OP)* primary ('[' expr? (':' expr?)? ']' | '.' (name | '*'))* ;
primary = NUM | STR | PARAM | BODY | 'null' | 'true' | 'false' | 'default_' | '(' (query | exprs) ')' | 'case' expr? ('when' expr 'then' expr)+ ('else' expr)? 'end' | 'cast' '(' expr 'as' type ')' | 'exists' '(' query ')' | 'array' ('[' arrayitems? ']' | '(' query ')') | 'row' '(' exprs? ')' | 'interval' STR (ID)? | call | typed | 'user' | '*' ;
arrayitems = arrayitem (',' arrayitem)* ;
arrayitem = expr | '[' arrayitems? ']' ;
typed = ID STR ;
call = qname ('(' funcargs? ')' (ID 'group' '(' 'order' 'by' sortlist ')')? ('filter' '(' 'where' expr ')')? ('over' (name | windowdef))?)? | ('left' | 'right' | 'replace' | 'values_') '(' funcargs? ')' ;
funcargs = ('distinct' | 'all')? funcarg (',' funcarg)* ('order' 'by' sortlist)? ;
funcarg = expr | name ('=' '>' | ':=' | OP) expr | ID 'from' expr | expr 'from' expr ('for' expr)? | expr 'for' expr | atom 'in' expr | ID? 'from' expr ;
windowdef = '(' name? ('partition' 'by' exprs)? ('order' 'by' sortlist)? (('rows' | 'range' | ID) frame)? ')' ;
frame = bound | 'between' bound 'and' bound ;
bound = ('unbounded' | expr) ('preceding' | 'following') | 'current' 'row' ;
""" + f"""
name = ID | KIND | OPERATOR | SCOPE | STEP | {' | '.join(repr(w) for w in sorted(SQL_WORDS - _SQL_RESERVED))} ;
id = name ;
word = ID | KIND | OPERATOR | SCOPE | STEP | {' | '.join(repr(w) for w in sorted(SQL_WORDS))} ;
"""

#: Bodies of functions in the procedural language; embedded SQL takes the rules above.
PLPGSQL = SQL.replace("script = (statement? ';')* statement? ;", """
script = blockstmt ';'? ;
blockstmt = ('<' '<' id '>' '>' | OP id OP)? (ID (vardecl)*)? 'begin' step* ('exception' ('when' expr 'then' step*)+)? 'end' id? ;
vardecl = name ID? type ('collate' qname)? ('not' 'null')? (('default' | ':=' | '=') expr)? ';' | name ID? ID? 'for' query ';' | name 'cursor_' ;
step = blockstmt ';' | returnstep ';' | qname ('[' expr ']')* (':=' | '=') expr ';' | ifstep ';' | looplabel? ('while' expr | 'for' name 'in' (ID)? (expr '..' expr ('by' expr)? | query | ID expr ('using' exprs)?))? 'loop' step* 'end' 'loop' id? ';'
  | STEP id? ('when' expr)? ';' | 'raise' (ID | STR | ',' | expr | 'using' | '=')* ';' | 'perform' selectitem (',' selectitem)* ('from' fromitem (',' fromitem)*)? ('where' expr)? ('order' 'by' sortlist)? (limit)* ';' | 'null' ';' | statement ';' | casestep ';' | STEP run ';' ;
looplabel = '<' '<' id '>' '>' | OP id OP ;
returnstep = 'return' (expr | ID expr | 'query' query | ID query)? ;
ifstep = 'if' expr 'then' step* (('elsif' | ID) expr 'then' step*)* ('else' step*)? 'end' 'if' ;
casestep = 'case' expr? ('when' exprs 'then' step*)+ ('else' step*)? 'end' 'case' ;
""").replace("'query' query | ", "")

PYTHON = """
file = (NEWLINE | stmt)* ;
stmt = simple | compound ;
simple = small (';' small)* ';'? NEWLINE ;
small = assignment | 'pass' | 'break' | 'continue' | 'return' exprlist? | 'raise' (test ('from' test)?)? | 'global' names | 'nonlocal' names | 'del' exprlist | 'assert' test (',' test)? | import | 'type' ID tparams? '=' test ;
names = name (',' name)* ;
name = ID | 'match' | 'case' | 'type' ;
assignment = exprlist (':' test ('=' (yield | exprlist))? | augassign (yield | exprlist) | ('=' (yield | exprlist))*) | yield ;
augassign = '+=' | '-=' | '*=' | '/=' | '%=' | '&=' | '|=' | '^=' | '@=' | '<<=' | '>>=' | '**=' | '//=' ;
import = 'import' dotted ('as' name)? (',' dotted ('as' name)?)* | 'from' (('.' | '...')* dotted | ('.' | '...')+) 'import' ('*' | '(' aliases ','? ')' | aliases) ;
dotted = name ('.' name)* ;
aliases = name ('as' name)? (',' name ('as' name)?)* ;
suite = simple | NEWLINE+ INDENT (stmt | NEWLINE)+ DEDENT ;
compound = 'if' named ':' suite ('elif' named ':' suite)* ('else' ':' suite)? | 'while' named ':' suite ('else' ':' suite)? | 'async'? 'for' exprlist 'in' exprlist ':' suite ('else' ':' suite)?
  | 'try' ':' suite (except+ ('else' ':' suite)? ('finally' ':' suite)? | 'finally' ':' suite) | 'async'? 'with' withitems ':' suite | decorated | 'match' exprlist ':' NEWLINE+ INDENT ('case' patterns ('if' named)? ':' suite)+ DEDENT ;
except = 'except' '*'? (test (',' test)* ('as' name)?)? ':' suite ;
withitems = withitem (',' withitem)* ','? | '(' withitem (',' withitem)* ','? ')' ;
withitem = test ('as' target)? ;
target = postfix | '(' target (',' target)* ','? ')' | '[' target (',' target)* ','? ']' ;
decorated = ('@' named NEWLINE+)* ('async'? function | class) ;
function = 'def' name tparams? '(' params? ')' ('->' test)? ':' suite ;
class = 'class' name tparams? ('(' args? ')')? ':' suite ;
tparams = '[' tparam (',' tparam)* ','? ']' ;
tparam = ('*' | '**')? name (':' test)? ('=' test)? ;
params = param (',' param)* ','? ;
param = name (':' test)? ('=' test)? | '/' | '*' (name (':' ('*')? test)?)? | '**' name (':' test)? ;
exprlist = item (',' item)* ','? ;
item = named | '*' operation ;
named = test (':=' test)? ;
yield = 'yield' ('from' test | exprlist)? ;
test = lambda | operation ('if' operation 'else' test)? ;
lambda = 'lambda' lparams? ':' test ;
lparams = lparam (',' lparam)* ','? ;
lparam = name ('=' test)? | '/' | '*' name? | '**' name ;
operation = unary (binop unary)* ;
binop = 'or' | 'and' | '<' | '>' | '==' | '>=' | '<=' | '!=' | 'in' | 'not' 'in' | 'is' | 'is' 'not' | '|' | '^' | '&' | '<<' | '>>' | '+' | '-' | '*' | '/' | '//' | '%' | '@' | '**' ;
unary = ('not' | '+' | '-' | '~' | 'await')* (postfix | lambda) ;
postfix = primary ('(' args? ')' | '[' subscripts ']' | '.' name)* ;
subscripts = subscript (',' subscript)* ','? ;
subscript = '*' operation | test (':=' test | ':' test? (':' test?)?)? | ':' test? (':' test?)? ;
primary = name | NUM | STR+ | '...' | 'None' | 'True' | 'False' | '(' (yield | items)? ')' | '[' items? ']' | '{' braced? '}' ;
items = item (comp | (',' item)* ','?) ;
braced = test (':' test (comp | (',' dictitem)* ','?) | (':=' test)? (comp | (',' item)* ','?)) | '*' operation (comp | (',' item)* ','?) | '**' operation (comp | (',' dictitem)* ','?) ;
dictitem = test ':' test | '**' operation ;
comp = ('async'? 'for' exprlist_in 'in' operation ('if' operation (':=' test)?)*)+ ;
exprlist_in = target_item (',' target_item)* ','? ;
target_item = '*'? target ;
args = arg (',' arg)* ','? ;
arg = name '=' test | named comp? | '*' test | '**' test ;
patterns = opattern (',' opattern)* ','? ;
opattern = '*' name | pattern ;
pattern = orpattern ('as' name)? ;
orpattern = closed ('|' closed)* ;
closed = '-'? NUM (('+' | '-') NUM)? | STR+ | 'None' | 'True' | 'False' | name ('.' name)* ('(' (patarg (',' patarg)* ','?)? ')')? | '(' (opattern (',' opattern)* ','?)? ')' | '[' (opattern (',' opattern)* ','?)? ']' | '{' (mapitem (',' mapitem)* ','?)? '}' ;
patarg = (name '=')? pattern ;
mapitem = closed ':' pattern | '**' name ;
"""

YAML = """
stream = (document | DOCSTART node? DOCEND* | DOCEND)* ;
document = node DOCEND* ;
node = ALIAS | props? bare | props ;
props = (ANCHOR | TAG)+ ;
bare = SCALAR | BLOCK | MAPSTART pair+ END | SEQSTART entry+ END | flow ;
pair = KEY inlinekey? VALUE node? | KEY inlinekey | VALUE node? ;
inlinekey = node ;
entry = ENTRY node? ;
flow = '[' (flowitem (',' flowitem)* ','?)? ']' | '{' (flowpair (',' flowpair)* ','?)? '}' ;
flownode = ALIAS | props? (SCALAR | flow) | props ;
flowitem = flownode | flowpair_of ;
flowpair_of = KEY flownode? (VALUE flownode?)? | VALUE flownode? ;
flowpair = flownode | flowpair_of ;
"""

_BUILT: dict[str, Grammar] = {}
_SOURCES = {
    "json": (JSON, "value"), "java": (JAVA, "unit"), "ts": (TS, "program"), "sql": (SQL, "script"), "plpgsql": (PLPGSQL, "script"), "py": (PYTHON, "file"), "yaml": (YAML, "stream"),
}


def grammar(name: str) -> Grammar:
    """The grammar of a language, built once in a process."""
    if name not in _BUILT:
        _BUILT[name] = Grammar(XML, "document", {"element": _element}) if name == "xml" else Grammar(*_SOURCES[name])
    return _BUILT[name]
