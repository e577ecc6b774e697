"""Bundled grammars for the parsers of problem 6, in the notation of :mod:`glr`.

Operator precedence does not decide validity, so expressions are flat chains; what a
language checks after parsing (names, types, targets of assignment) is left out.
"""

from __future__ import annotations

#: ECMAScript modules; lines tagged @ts add TypeScript.
SCRIPT = r"""
program: stmt*
block: '{' stmt* '}'
stmt: block | ';' | decl | vars ';' | estmt ';' | label_stmt
stmt: 'if' '(' expr ')' stmt ('else' stmt)?
stmt: 'for' 'await'? '(' for_head ')' stmt | 'while' '(' expr ')' stmt | 'do' stmt 'while' '(' expr ')' ';' | 'do' stmt 'while' '(' expr ')'
stmt: 'switch' '(' expr ')' '{' case* '}' | 'try' block ('catch' ('(' target ann? ')')? block)? ('finally' block)?
stmt: 'throw' expr ';' | 'return' expr? ';' | 'break' name? ';' | 'continue' name? ';' | 'debugger' ';'
stmt: import_stmt | export_stmt
label_stmt: name ':' stmt
case: ('case' expr | 'default') ':' stmt*
for_head: (vars | expr)? ';' expr? ';' expr? | ('var' | 'let' | 'const') target ann? ('of' assign | 'in' expr) | postfix ('of' assign | 'in' expr)
vars: ('var' | 'let') vdecl (',' vdecl)* | 'const' cdecl (',' cdecl)*
vdecl: target ann? ('=' assign)?
@ts vdecl: name '!' ann
cdecl: target ann? '=' assign
@ts cdecl: target ann
target: name | '{' (bind (',' bind)* ','?)? '}' | '[' (','? belem)* ','* ']'
bind: propname ':' target ('=' assign)? | name ('=' assign)? | '...' target
belem: '...'? target ('=' assign)? ','?
decl: func_decl | class_decl
func_decl: 'async'? 'function' '*'? name func_rest block
@ts func_decl: 'async'? 'function' '*'? name func_rest ';'
func_rest: tparams? '(' params? ')' retann?
params: param (',' param)* ','?
param: deco* pmod* '...'? target '?'? ann? ('=' assign)?
@ts param: 'this' ann
@ts pmod: 'public' | 'private' | 'protected' | 'readonly' | 'override'
@ts ann: ':' type
@ts retann: ':' type
class_decl: deco* 'abstract'? 'class' name? tparams? heritage* '{' member* '}'
heritage: 'extends' unary
@ts heritage: 'extends' postfix targs | 'implements' typeref (',' typeref)*
@ts deco: '@' postfix
mod: 'static' | 'async'
mod: 'accessor'
@ts mod: 'public' | 'private' | 'protected' | 'readonly' | 'abstract' | 'override' | 'declare'
member: ';' | deco* mod* '*'? ('get' | 'set')? propname opt? func_rest block | deco* mod* propname opt? ann? ('=' assign)? ';' | 'static' block
@ts member: deco* mod* '*'? ('get' | 'set')? propname opt? func_rest ';' | mod* '[' name ':' type ']' ann ';'
@ts opt: '?' | '!'
propname: anyname | STR | NUM | PRIV | '[' assign ']'
name: NAME | 'async' | 'of' | 'get' | 'set' | 'static' | 'from' | 'as' | 'accessor'
@ts name: 'type' | 'interface' | 'namespace' | 'module' | 'declare' | 'abstract' | 'readonly' | 'is' | 'infer' | 'keyof' | 'unique' | 'asserts' | 'satisfies' | 'override' | 'public' | 'private' | 'protected' | 'global' | 'implements' | 'require' | 'out'
anyname: name | 'break' | 'case' | 'catch' | 'class' | 'const' | 'continue' | 'debugger' | 'default' | 'delete' | 'do' | 'else' | 'export' | 'extends' | 'finally' | 'for' | 'function' | 'if' | 'import' | 'in' | 'instanceof' | 'new' | 'return' | 'super' | 'switch' | 'this' | 'throw' | 'try' | 'typeof' | 'var' | 'let' | 'void' | 'while' | 'with' | 'yield' | 'await' | 'null' | 'true' | 'false' | 'enum'
import_stmt: 'import' STR attrs? ';' | 'import' import_clause 'from' STR attrs? ';'
@ts import_stmt: 'import' 'type' import_clause 'from' STR attrs? ';' | 'import' 'type'? name '=' (entity | 'require' '(' STR ')') ';'
attrs: ('with' | 'assert') object
import_clause: name | (name ',')? ('*' 'as' name | specs)
specs: '{' (spec (',' spec)* ','?)? '}'
spec: (anyname | STR) ('as' (anyname | STR))?
@ts spec: 'type' anyname ('as' anyname)?
export_stmt: 'export' '*' ('as' (anyname | STR))? 'from' STR attrs? ';' | 'export' specs ('from' STR attrs?)? ';' | 'export' decl | 'export' vars ';'
export_stmt: 'export' 'default' (anon_decl | estmt ';' | object tail* ';')
@ts export_stmt: 'export' 'type' (specs | '*' ('as' anyname)?) ('from' STR)? ';' | 'export' '=' expr ';' | 'export' 'as' 'namespace' name ';' | 'export' 'default' ts_decl
anon_decl: 'async'? 'function' '*'? name? func_rest block | class_decl
@ts decl: ts_decl
@ts ts_decl: 'interface' name tparams? ('extends' typeref (',' typeref)*)? objtype | 'type' name tparams? '=' type ';' | 'const'? 'enum' name '{' (enum_item (',' enum_item)* ','?)? '}'
@ts ts_decl: ('namespace' | 'module') (entity | STR) block | 'declare' 'module' STR ';' | 'declare' decl | 'declare' ('const' | 'let' | 'var') ambient (',' ambient)* ';' | 'declare' 'global' block
@ts ambient: name ann?
@ts enum_item: propname ('=' assign)?
expr: assign (',' assign)*
assign: chain | chain '?' assign ':' assign | place setop assign | arrow | 'yield' '*'? assign | 'yield'
chain: unary | chain binop unary
@ts chain: chain ('as' | 'satisfies') type | chain 'as' 'const'
setop: '=' | OPSET | '>' '>=' | '>' '>' '>='
binop: OP | '*' | '-' | '+' | '<' | '>' | '>=' | '>' '>' | '>' '>' '>' | '/' | '|' | '&' | 'in' | 'instanceof'
unary: prefix unary | postfix INCR? | PRIV 'in' unary
prefix: '+' | '-' | '!' | '~' | INCR | PREINCR | 'typeof' | 'void' | 'delete' | 'await' | 'new'
@ts prefix: '<' type '>'
postfix: literal | place
place: primary | postfix tail
literal: STR | NUM | REGEX | template | 'this' | 'super' | 'null' | 'true' | 'false' | anon_func | class_expr
tail: '.' (anyname | PRIV) | '?.' (anyname | PRIV | '[' expr ']' | args | template) | '[' expr ']' | args | template
@ts tail: '!' | targs args | targs template | targs
args: '(' (arg (',' arg)* ','?)? ')'
arg: '...'? assign
primary: nb_primary | object
nb_primary: name | '(' expr ')' | array | 'import' args | 'import' '.' anyname | 'new' '.' NAME
nb_literal: STR | NUM | REGEX | template | 'this' | 'super' | 'null' | 'true' | 'false'
anon_func: 'async'? 'function' '*'? name? func_rest block
class_expr: deco* 'class' name? tparams? heritage* '{' member* '}'
array: '[' (','* '...'? assign)? (',' ','* '...'? assign)* ','* ']'
object: '{' (prop (',' prop)* ','?)? '}'
prop: propname ':' assign | name ('=' assign)? | '...' assign | 'async'? '*'? ('get' | 'set')? propname func_rest block
template: TPL | TPL_HEAD expr (TPL_MID expr)* TPL_TAIL
arrow: 'async'? name '=>' body | 'async'? tparams? '(' params? ')' retann? '=>' body
body: block | assign
estmt: nb_assign (',' assign)*
nb_assign: nb_chain | nb_chain '?' assign ':' assign | nb_place setop assign | pattern_set | arrow | 'yield' '*'? assign | 'yield'
nb_chain: nb_unary | nb_chain binop unary
@ts nb_chain: nb_chain ('as' | 'satisfies') type | nb_chain 'as' 'const'
pattern_set: '(' object setop assign ')'
nb_unary: prefix unary | nb_postfix INCR? | PRIV 'in' unary
nb_postfix: nb_literal | nb_place
nb_place: nb_primary | nb_postfix tail
@ts type: utype | utype 'extends' type '?' type ':' type | functype | 'asserts' (name | 'this') ('is' type)? | (name | 'this') 'is' type
@ts functype: 'abstract'? 'new'? tparams? '(' params? ')' '=>' type
@ts utype: ('|' | '&')? optype (('|' | '&') optype)*
@ts optype: ('keyof' | 'unique' | 'readonly') optype | 'infer' name ('extends' utype)? | posttype
@ts posttype: ptype | posttype '[' ']' | posttype '[' type ']'
@ts ptype: '(' type ')' | typeref | STR | NUM | '-' NUM | TPL | TPL_HEAD type (TPL_MID type)* TPL_TAIL | 'null' | 'true' | 'false' | 'void' | 'this' | 'typeof' entity targs? | '[' (telem (',' telem)* ','?)? ']' | objtype
@ts ptype: 'typeof'? 'import' '(' STR ')' ('.' anyname)* targs?
@ts typeref: entity targs?
@ts entity: name | entity '.' anyname
@ts targs: '<' type (',' type)* '>'
@ts telem: '...'? type | '...'? name '?'? ':' type | type '?'
@ts objtype: '{' (tmember (';' | ','))* tmember? '}' | '{' mapped '}'
@ts tmember: ('readonly' | 'get' | 'set')? propname '?'? tparams? '(' params? ')' retann? | 'new'? tparams? '(' params? ')' retann? | 'readonly'? propname '?'? ann? | 'readonly'? '[' name ':' type ']' ann
@ts mapped: (('+' | '-')? 'readonly')? '[' name 'in' type ('as' type)? ']' (('+' | '-')? '?')? ann? ';'?
@ts tparams: '<' tparam (',' tparam)* ','? '>'
@ts tparam: ('const' | 'in' | 'out')* name ('extends' type)? ('=' type)?
@js tparams: NEVER
@js ann: NEVER
@js retann: NEVER
@js deco: '@' postfix
@js pmod: NEVER
@js opt: NEVER
@js typeref: NEVER
"""

PYTHON = r"""
file: (NEWLINE | stmt)*
stmt: simple (';' simple)* ';'? NEWLINE | compound
block: simple (';' simple)* ';'? NEWLINE | NEWLINE INDENT stmt+ DEDENT
simple: exprs | place setop (exprs | yield) | (places '=')+ (exprs | yield) | (place | '(' place ')') ':' expr ('=' (exprs | yield))? | yield
places: splace (',' splace)* ','?
splace: '*'? place | '*'? '(' places? ')' | '*'? '[' places? ']'
place: name | postfix '.' name | postfix '[' subs ']'
simple: 'pass' | 'break' | 'continue' | 'return' exprs? | 'raise' (expr ('from' expr)?)? | 'del' exprs | 'global' name (',' name)* | 'nonlocal' name (',' name)* | 'assert' expr (',' expr)?
simple: 'import' dotted_as (',' dotted_as)* | 'from' dots? dotted? 'import' ('*' | '(' name_as (',' name_as)* ','? ')' | name_as (',' name_as)*) | 'type' name tparams? '=' expr
dots: ('.' | '...')+
dotted: name ('.' name)*
dotted_as: dotted ('as' name)?
name_as: name ('as' name)?
yield: 'yield' exprs? | 'yield' 'from' expr
setop: OPSET
compound: deco* 'async'? 'def' name tparams? '(' params? ')' ('->' exprs)? ':' block | deco* 'class' name tparams? ('(' args? ')')? ':' block
compound: 'if' named ':' block ('elif' named ':' block)* ('else' ':' block)? | 'while' named ':' block ('else' ':' block)? | 'async'? 'for' targets 'in' exprs ':' block ('else' ':' block)?
compound: 'try' ':' block (except+ ('else' ':' block)? ('finally' ':' block)? | 'finally' ':' block)
compound: 'async'? 'with' with_items ':' block | 'match' exprs ':' NEWLINE INDENT case+ DEDENT
except: 'except' '*'? (exprs ('as' name)?)? ':' block
with_items: with_item (',' with_item)* | '(' with_item (',' with_item)* ','? ')'
with_item: expr ('as' expr)?
case: 'case' patterns ('if' named)? ':' block
patterns: pattern (',' pattern)* ','?
pattern: '*'? or_pattern ('as' name)?
or_pattern: closed ('|' closed)*
closed: '-'? NUM (('+' | '-') NUM)? | STR+ | 'None' | 'True' | 'False' | dotted | dotted '(' (kwpat (',' kwpat)* ','?)? ')' | '[' patterns? ']' | '(' patterns? ')' | '{' (mpat (',' mpat)* ','?)? '}'
kwpat: pattern | name '=' pattern
mpat: closed ':' pattern | '**' name
deco: '@' named NEWLINE
tparams: '[' tparam (',' tparam)* ','? ']'
tparam: ('*' | '**')? name (':' expr)? ('=' expr)?
params: plain | given | rest
plain: typed ','? | typed ',' (plain | given | rest) | typed ',' '/' ','? | typed ',' '/' ',' (plain | given | rest)
given: typed '=' expr ','? | typed '=' expr ',' (given | rest) | typed '=' expr ',' '/' ','? | typed '=' expr ',' '/' ',' (given | rest)
rest: '*' name (':' star)? (',' keyed)* (',' keys)? ','? | '*' (',' keyed)+ (',' keys)? ','? | keys ','?
keyed: typed ('=' expr)?
keys: '**' typed
typed: name (':' expr)?
lparams: lplain | lgiven | lrest
lplain: name ','? | name ',' (lplain | lgiven | lrest) | name ',' '/' ','? | name ',' '/' ',' (lplain | lgiven | lrest)
lgiven: name '=' expr ','? | name '=' expr ',' (lgiven | lrest) | name '=' expr ',' '/' ','? | name '=' expr ',' '/' ',' (lgiven | lrest)
lrest: '*' name (',' name ('=' expr)?)* (',' '**' name)? ','? | '*' (',' name ('=' expr)?)+ (',' '**' name)? ','? | '**' name ','?
exprs: star (',' star)* ','?
star: '*' chain | named
named: expr | name ':=' expr
targets: target (',' target)* ','?
target: '*'? prefix* postfix
expr: chain | chain 'if' chain 'else' expr | 'lambda' lparams? ':' expr
chain: unary | chain binop unary
binop: OP | '*' | '**' | '-' | '+' | '|' | '/' | '@' | '<' | '>' | 'and' | 'or' | 'in' | 'not' 'in' | 'is' | 'is' 'not'
unary: prefix unary | postfix
prefix: '+' | '-' | '~' | 'not' | 'await'
postfix: atom | postfix '.' name | postfix '[' subs ']' | postfix '(' args? ')'
subs: sub (',' sub)* ','?
sub: star | expr? ':' expr? (':' expr?)?
args: arg (',' arg)* ','?
arg: named | named comp+ | name '=' expr | '*' expr | '**' expr
atom: name | NUM | STR+ | 'None' | 'True' | 'False' | '...' | '(' ')' | '(' exprs ')' | '(' yield ')' | '(' named comp+ ')' | '[' exprs? ']' | '[' star comp+ ']' | '{' '}' | '{' item (',' item)* ','? '}' | '{' star comp+ '}' | '{' expr ':' expr comp+ '}'
item: expr ':' expr | '**' chain | star
comp: 'async'? 'for' targets 'in' chain comp_if*
comp_if: 'if' nocond
nocond: chain | 'lambda' lparams? ':' expr | name ':=' expr
name: NAME | 'match' | 'case' | 'type'
"""

JAVA = r"""
unit: package? (import | ';')* (type_decl | ';')*
unit: package? (import | ';')* mods 'module' qname '{' directive* '}'
directive: 'requires' ('static' | NAME)* qname ';' | NAME qname (NAME qname (',' qname)*)? ';'
package: anno* 'package' qname ';'
import: 'import' 'static'? qname ('.' '*')? ';'
qname: name ('.' name)*
name: NAME | 'record' | 'var' | 'yield' | 'sealed' | 'permits' | 'module' | 'requires' | 'when'
mods: mod*
mod: 'public' | 'private' | 'protected' | 'static' | 'final' | 'abstract' | 'native' | 'synchronized' | 'transient' | 'volatile' | 'strictfp' | 'default' | 'sealed' | NONSEALED | anno
anno: '@' qname ('(' (pair (',' pair)* ','? | elem)? ')')?
pair: name '=' elem
elem: expr | anno | '{' (elem (',' elem)* ','?)? '}'
type_decl: mods 'class' name tparams? ('extends' type)? ('implements' types)? ('permits' types)? body | mods 'interface' name tparams? ('extends' types)? ('permits' types)? body
type_decl: mods 'enum' name ('implements' types)? '{' (const (',' const)*)? ','? (';' member*)? '}' | mods 'record' name tparams? '(' (rparam (',' rparam)*)? ')' ('implements' types)? body | mods '@' 'interface' name body
rparam: anno* type '...'? name
const: anno* name args? body?
body: '{' member* '}'
member: ';' | type_decl | mods block | mods tparams? type name '(' params? ')' dims? throws? (block | ('default' elem)? ';') | mods tparams? 'void' name '(' params? ')' throws? (block | ';')
member: mods tparams? name '(' params? ')' throws? block | mods name block | mods type declarators ';'
throws: 'throws' types
params: param (',' param)*
param: pmod* type anno* '...'? name dims? | pmod* type (name '.')? 'this'
pmod: 'final' | anno
dims: (anno* '[' ']')+
tparams: '<' tparam (',' tparam)* '>'
tparam: anno* name ('extends' type ('&' type)*)?
types: type (',' type)*
type: anno* PRIM dims? | anno* ctype dims?
ctype: name targs? | ctype '.' anno* name targs?
targs: '<' (targ (',' targ)*)? '>'
targ: type | anno* '?' (('extends' | 'super') type)?
declarators: declarator (',' declarator)*
declarator: name dims? ('=' init)?
init: expr | '{' (init (',' init)* ','?)? '}'
block: '{' bstmt* '}'
bstmt: stmt | pmod* type declarators ';' | type_decl
stmt: block | ';' | sexpr ';' | 'if' '(' expr ')' stmt ('else' stmt)? | 'while' '(' expr ')' stmt | 'do' stmt 'while' '(' expr ')' ';'
stmt: 'for' '(' for_init? ';' expr? ';' (sexpr (',' sexpr)*)? ')' stmt | 'for' '(' pmod* type name dims? ':' expr ')' stmt
for_init: pmod* type declarators | sexpr (',' sexpr)*
stmt: 'return' expr? ';' | 'throw' expr ';' | 'break' name? ';' | 'continue' name? ';' | 'assert' expr (':' expr)? ';' | name ':' stmt | 'synchronized' '(' expr ')' block | 'yield' expr ';'
stmt: 'try' ('(' res (';' res)* ';'? ')')? block catch* ('finally' block)? | switch
res: pmod* type name '=' expr | postfix
catch: 'catch' '(' pmod* type ('|' type)* name ')' block
switch: 'switch' '(' expr ')' '{' (label ':' bstmt*)* '}' | 'switch' '(' expr ')' '{' rule+ '}'
rule: label '->' (expr ';' | block | 'throw' expr ';')
label: 'case' clabel (',' clabel)* ('when' expr)? | 'default'
clabel: chain | pattern | 'default'
pattern: pmod* type name | type '(' (pattern (',' pattern)*)? ')' name?
sexpr: INCR unary | postfix INCR | postfix setop expr | call
call: name args | postfix '.' targs? name args | 'this' args | 'super' args | creation | postfix '.' targs? ('super' | 'this') args | postfix '.' creation
setop: '=' | OPSET | '>' '>=' | '>' '>' '>='
expr: chain | lambda | chain '?' expr ':' expr | postfix setop expr
chain: unary | chain binop unary | chain 'instanceof' ('final'? type | pattern)
binop: OP | '*' | '-' | '+' | '<' | '>' | '>=' | '>' '>' | '>' '>' '>' | '|' | '&'
lambda: name '->' lbody | '(' (name (',' name)*)? ')' '->' lbody | '(' params ')' '->' lbody
lbody: expr | block
unary: ('+' | '-' | '!' | '~' | INCR) unary | '(' PRIM dims? ')' unary | '(' type ('&' type)* ')' (castee | lambda) | postfix INCR?
castee: ('!' | '~') unary | postfix INCR? | '(' type ('&' type)* ')' (castee | lambda)
postfix: primary | postfix '.' targs? name | postfix '[' expr ']' | postfix '::' targs? (name | 'new') | type '::' targs? (name | 'new') | type '.' 'class' | 'void' '.' 'class' | call | postfix '.' ('this' | 'super')
primary: name | LIT | 'this' | 'super' | '(' expr ')' | switch_expr | array_new
switch_expr: switch
creation: 'new' targs? anno* ctype args body?
array_new: 'new' anno* (ctype | PRIM) (anno* '[' expr ']')+ dims? | 'new' anno* (ctype | PRIM) dims '{' (init (',' init)* ','?)? '}'
args: '(' (expr (',' expr)*)? ')'
"""

C = r"""
unit: ext*
ext: ';' | specs declarator kr* block | decl | asm ';' | 'extension' ext
kr: decl
decl: specs (init_decl (',' init_decl)*)? ';' | assert ';'
assert: STATIC_ASSERT '(' expr (',' STR+)? ')'
init_decl: declarator attr* ('=' init)?
specs: qual* core qual* | qual* BUILTIN (qual | BUILTIN)*
core: NAME | su | enum | typeof
typeof: TYPEOF '(' (expr | type_name) ')' | ATOMIC '(' type_name ')'
qual: QUAL | attr | ALIGNAS '(' (expr | type_name) ')'
attr: ATTR '(' '(' attr_item? (',' attr_item?)* ')' ')' | asm
attr_item: any_name ('(' (expr (',' expr)*)? ')')?
any_name: NAME | QUAL | BUILTIN
asm: ASM QUAL* '(' STR+ (':' asm_ops?)* ')'
asm_ops: asm_op (',' asm_op)*
asm_op: ('[' NAME ']')? STR+ ('(' expr ')')?
su: ('struct' | 'union') attr* NAME | ('struct' | 'union') attr* NAME? '{' field* '}' attr*
field: specs (fdecl (',' fdecl)*)? ';' | ';' | assert ';'
fdecl: declarator attr* | declarator? ':' cond attr*
enum: 'enum' attr* NAME | 'enum' attr* NAME? '{' (enum_item (',' enum_item)* ','?)? '}' attr*
enum_item: NAME attr* ('=' cond)?
declarator: pointer* direct
pointer: '*' (QUAL | attr)*
direct: NAME | '(' attr* declarator ')' | direct '[' QUAL* cond? ']' | direct '[' QUAL* '*' ']' | direct '(' params? ')' | direct '(' NAME (',' NAME)* ')'
params: param (',' param)* (',' '...')?
param: specs (declarator | abstract)? attr*
abstract: pointer+ | pointer* adirect
adirect: '(' abstract ')' | adirect? '[' QUAL* cond? ']' | adirect? '(' params? ')'
type_name: specs abstract?
init: assign | '{' (item (',' item)* ','?)? '}'
item: (desig+ '=' | NAME ':')? init
desig: '[' cond ('...' cond)? ']' | '.' NAME
block: '{' bitem* '}'
bitem: decl | stmt | specs declarator block
stmt: block | ';' | expr ';' | 'if' '(' expr ')' stmt ('else' stmt)? | 'switch' '(' expr ')' stmt | 'while' '(' expr ')' stmt | 'do' stmt 'while' '(' expr ')' ';'
stmt: 'for' '(' (expr? ';' | decl) expr? ';' expr? ')' stmt | 'goto' '*'? (NAME | expr) ';' | 'continue' ';' | 'break' ';' | 'return' expr? ';' | asm ';'
stmt: NAME ':' attr* (stmt | decl)? | 'case' cond ('...' cond)? ':' (stmt | decl)? | 'default' ':' (stmt | decl)?
expr: assign (',' assign)*
assign: cond | unary setop assign
setop: '=' | OPSET
cond: chain | chain '?' expr? ':' cond
chain: cast | chain binop cast
binop: OP | '*' | '-' | '+' | '&'
cast: unary | '(' type_name ')' cast
unary: postfix | INCR unary | ('+' | '-' | '!' | '~' | '*' | '&') cast | SIZEOF unary | SIZEOF '(' type_name ')' | 'extension' cast
postfix: primary | postfix '[' expr ']' | postfix '(' (arg (',' arg)*)? ')' | postfix ('.' | '->') NAME | postfix INCR | '(' type_name ')' '{' (item (',' item)* ','?)? '}'
arg: assign | type_name
primary: NAME | NUM | STR (STR | NAME)* | CHAR | '(' expr ')' | '(' block ')' | GENERIC '(' assign (',' (type_name | 'default') ':' assign)+ ')'
"""

GO = r"""
file: 'package' NAME ';' (import ';')* (decl ';')*
import: 'import' (ispec | '(' (ispec ';')* ispec? ')')
ispec: (NAME | '.')? STR
decl: gdecl | func
gdecl: 'var' (vspec | '(' (vspec ';')* vspec? ')') | 'const' (cspec | '(' (cspec ';')* cspec? ')') | 'type' (tspec | '(' (tspec ';')* tspec? ')')
vspec: names type ('=' exprs)? | names '=' exprs
cspec: names (type? '=' exprs)?
tspec: NAME tparams? '='? type
tparams: '[' tparam (',' tparam)* ','? ']'
tparam: names union
union: '~'? type ('|' '~'? type)*
names: NAME (',' NAME)*
func: 'func' params? NAME tparams? sig block?
sig: params (params | type)?
params: '(' (param (',' param)* ','?)? ')'
param: '...'? type | NAME '...'? type
type: NAME | NAME '.' NAME | NAME ('.' NAME)? '[' type (',' type)* ','? ']' | '*' type | ctype | '(' type ')' | 'chan' '<-'? type | '<-' 'chan' type | 'func' sig | iface
ctype: '[' ']' type | '[' expr ']' type | '[' '...' ']' type | 'map' '[' type ']' type | struct
struct: 'struct' '{' (field ';')* field? '}'
field: names type STR? | '*'? NAME ('.' NAME)? ('[' type (',' type)* ']')? STR?
iface: 'interface' '{' (ielem ';')* ielem? '}'
ielem: NAME sig | union
block: '{' stmts '}'
stmts: (stmt? ';')* stmt?
stmt: gdecl | simple | block | 'return' exprs? | 'break' NAME? | 'continue' NAME? | 'goto' NAME | 'fallthrough' | NAME ':' stmt? | 'go' expr | 'defer' expr | if | for | switch | select
simple: expr | exprs (setop | ':=') exprs | expr INCR | expr '<-' expr
setop: '=' | OPSET
if: 'if' (simple? ';')? expr block ('else' (if | block))?
for: 'for' block | 'for' expr block | 'for' simple? ';' expr? ';' simple? block | 'for' (exprs ('=' | ':='))? 'range' expr block
switch: 'switch' (simple? ';')? simple? '{' clause* '}'
clause: ('case' (expr | ctype | otype) (',' (expr | ctype | otype))* | 'default') ':' stmts
otype: 'chan' '<-'? type | 'func' sig | iface | '*' ctype
select: 'select' '{' (('case' simple | 'default') ':' stmts)* '}'
exprs: expr (',' expr)*
expr: unary | expr binop unary
binop: OP | '*' | '-' | '+' | '|' | '&' | '^' | '<-'
unary: ('+' | '-' | '!' | '^' | '*' | '&' | '<-') unary | postfix
postfix: operand | postfix '.' NAME | postfix '.' '(' (type | 'type') ')' | postfix '[' targ (',' targ)* ','? ']' | postfix '[' expr? ':' expr? (':' expr)? ']' | postfix args | postfix lit
targ: expr | ctype | otype
operand: NAME | NUM | STR | '(' expr ')' | '(' otype ')' | '(' '*' type ')' | 'func' sig block | ctype lit | ctype '(' expr ','? ')' | otype '(' expr ')'
args: '(' ((expr | ctype | otype) (',' (expr | ctype | otype))* '...'? ','?)? ')'
lit: '{' (elem (',' elem)* ','?)? '}'
elem: (key ':')? key
key: expr | lit
"""
