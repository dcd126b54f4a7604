"""Grammars of the supported languages in the notation of ``gll``; operators carry no precedence, as only validity counts."""

from __future__ import annotations

from functools import cache

from .gll import Grammar

_BIN = """'==' | '===' | '!=' | '!==' | '<' | '<' '=' | '<=' | '>' | '>' '=' | '>' '>' | '>' '>' '>' | '<<' | '+' | '-' | '*' | '/' | '%' | '**'
 | '&' | '|' | '^' | '&&' | '||' | '??' | 'instanceof' | 'in' | '=' | '+=' | '-=' | '*=' | '/=' | '%=' | '**=' | '<<=' | '>>=' | '>>>=' | '&=' | '|=' | '^=' | '&&=' | '||=' | '??='"""

_ECMA = (
    """
Module = ModuleItem*
Script = Stmt*
ModuleItem = Import | Export | Stmt
Import = 'import' (str | ImportWhat 'from' str) With? Semi | [['import' 'type'? id '=' (id ('.' name)* | 'require' @p:Args) Semi]]
ImportWhat = [['type'?]] (id (',' ('*' 'as' id | @b:Specifiers))? | '*' 'as' id | @b:Specifiers)
With = ('with' | 'assert') @b:Object
Specifiers = (Specifier (',' Specifier)* ','?)?
Specifier = [['type'?]] (name | str) ('as' (name | str))?
Export = 'export' [['type'?]] ('*' ('as' (name | str))? 'from' str | @b:Specifiers ('from' str With?)?) Semi
 | 'export' 'default' (Function | Decorators? Class | [['abstract' Class | Interface |]] Assign Semi)
 | 'export' Declaration | Decorators 'export' 'default'? Class [[| 'export' '=' Expr Semi | 'export' 'as' 'namespace' id Semi | 'export' 'import' 'type'? id '=' (id ('.' name)* | 'require' @p:Args) Semi]]
Declaration = Var Semi | Function | Decorators? Class [[| Typed | 'abstract' Class | 'declare' (Declaration | Typed | 'global' @b:Module | Function)]]
Semi = ';' | &nl
Stmts = Stmt*
Stmt = @b:Stmts | Var Semi | Function | Decorators? Class | ';' | Expr Semi | 'if' @p:Expr Stmt ('else' Stmt)? | 'for' 'await'? @p:ForHead Stmt
 | 'while' @p:Expr Stmt | 'do' Stmt 'while' @p:Expr (Semi | &nl)? | 'continue' id? Semi | 'break' id? Semi | 'return' Expr? Semi | 'throw' Expr Semi
 | 'switch' @p:Expr @b:Cases | id ':' Stmt | 'try' @b:Stmts ('catch' @p:CatchParam? @b:Stmts)? ('finally' @b:Stmts)? | 'debugger' Semi | 'with' @p:Expr Stmt
 [[| Typed | 'abstract' Class | 'declare' (Declaration | Typed | 'global' @b:Module) | Import]]
Cases = (('case' Expr | 'default') ':' Stmt*)*
CatchParam = Binding [[TypeNote?]]
Var = ('var' | 'let' | 'const' | 'using' | 'await' 'using') VarOne (',' VarOne)*
VarOne = Binding [['!'? TypeNote?]] ('=' Assign)?
ForHead = (Var | Expr)? ';' Expr? ';' Expr? | ('var' | 'let' | 'const' | 'using' | 'await' 'using') Binding [[TypeNote?]] ('=' Assign)? ('of' | 'in') Expr | Postfix ('of' | 'in') Expr
Binding = id | @s:BindList | @b:BindProps
BindList = BindElem? (',' BindElem?)*
BindElem = '...'? Binding ('=' Assign)?
BindProps = (BindProp (',' BindProp)* ','?)?
BindProp = id ('=' Assign)? | PropName ':' Binding ('=' Assign)? | '...' Binding
Function = 'async'? 'function' '*'? id? [[TypeParams?]] @p:Params [[TypeNote?]] (@b:Stmts [[| Semi]])
Params = (Param (',' Param)* ','?)?
Param = Decorators? [[Modifier*]] '...'? (Binding [['?'? TypeNote?]] [[| 'this' TypeNote]]) ('=' Assign)?
Decorators = Decorator+
Decorator = '@' (id ('.' name)* @p:Args? | @p:Expr)
Class = 'class' id? [[TypeParams?]] ('extends' Postfix [[TypeArgs?]])? [[('implements' TypeRef (',' TypeRef)*)?]] @b:Members
Members = Member*
Member = ';' | 'static' @b:Stmts | Decorators? Modifier* (Method | Field) [[| Modifier* Index Semi]]
Modifier = 'static' | 'accessor' [[| 'public' | 'private' | 'protected' | 'readonly' | 'abstract' | 'declare' | 'override']]
Method = 'async'? '*'? PropName [['?'? TypeParams?]] @p:Params [[TypeNote?]] (@b:Stmts [[| Semi]]) | ('get' | 'set') PropName @p:Params [[TypeNote?]] (@b:Stmts [[| Semi]])
Field = PropName [[('?' | '!')? TypeNote?]] ('=' Assign)? Semi
PropName = name | str | num | @s:Assign
Object = (Prop (',' Prop)* ','?)?
Prop = id ('=' Assign)? | PropName ':' Assign | '...' Assign | MethodProp
MethodProp = 'async'? '*'? PropName [[TypeParams?]] @p:Params [[TypeNote?]] @b:Stmts | ('get' | 'set') PropName @p:Params [[TypeNote?]] @b:Stmts
Elements = ','* (Element (','+ Element)* ','*)?
Args = (Element (',' Element)* ','?)?
Element = '...'? Assign
Expr = Assign (',' Assign)*
Assign = Operand (Binary Operand)* ('?' Assign ':' Assign)? | 'yield' '*'? Assign? | Arrow | Operand (Binary Operand)* Binary Arrow
Binary = """
    + _BIN
    + """
Arrow = 'async'? (id | [[TypeParams?]] @p:Params [[(':' RetType)?]]) '=>' (@b:Stmts | Assign)
Operand = Prefix* Postfix
Prefix = '!' | '~' | '+' | '-' | '++' | '--' | 'typeof' | 'void' | 'delete' | 'await' | 'new' [[| '<' Type GT]]
Postfix = Primary Suffix*
Suffix = '.' name | '?.' (name | @s:Expr | @p:Args | Template) | @s:Expr | @p:Args | Template | '++' | '--' [[| '!' | ('as' | 'satisfies') Type | TypeArgs]]
Primary = id | 'this' | 'super' | 'null' | 'true' | 'false' | num | str | regex | Template | @p:Expr | @s:Elements | @b:Object | 'async'? 'function' '*'? id? [[TypeParams?]] @p:Params [[TypeNote?]] @b:Stmts
 | Decorators? Class | 'import' (@p:Args | '.' name) | 'new' '.' name
Template = tmpl (@e:Expr tmpl)* tend
[[TypeNote = ':' RetType
RetType = Type | 'asserts'? (id | 'this') 'is' Type | 'asserts' (id | 'this')
Type = Union ('extends' Union '?' Type ':' Type)?
Union = ('|' | '&')? TypeOp (('|' | '&') TypeOp)*
TypeOp = ('keyof' | 'unique' | 'readonly' | 'infer')* PostType
PostType = PrimType @s:TypeIndex*
TypeIndex = Type?
PrimType = TypeRef | 'this' | 'null' | 'void' | 'true' | 'false' | '-'? num | str | tmpl (@e:Type tmpl)* tend | @b:TypeMembers | @s:TupleElems | @p:Type | 'abstract'? 'new'? TypeParams? @p:Params '=>' RetType
 | 'typeof' (id | 'this' | 'import' @p:Args) ('.' name)* TypeArgs? | 'import' @p:Args ('.' name)* TypeArgs?
TypeRef = id ('.' name)* TypeArgs?
TypeArgs = '<' Type (',' Type)* ','? GT
TypeParams = '<' TypeParam (',' TypeParam)* ','? GT
TypeParam = ('const' | 'in' | 'out')* id ('extends' Type)? ('=' Type)?
GT = '>'
TupleElems = (TupleElem (',' TupleElem)* ','?)?
TupleElem = '...'? (Type '?'? | name '?'? ':' Type)
TypeMembers = TypeMember*
TypeMember = (TypeProp | Index | Mapped) (';' | ',' | &nl) | ';'
TypeProp = 'readonly'? PropName '?'? TypeNote? | ('get' | 'set')? PropName '?'? TypeParams? @p:Params TypeNote? | 'new'? TypeParams? @p:Params TypeNote?
Index = @s:IndexKey TypeNote
IndexKey = id ':' Type
Mapped = (('+' | '-')? 'readonly')? @s:MappedKey (('+' | '-')? '?')? TypeNote
MappedKey = id 'in' Type ('as' Type)?
Typed = Interface | 'type' id TypeParams? '=' Type Semi | 'const'? 'enum' id @b:Enum | ('namespace' | 'module') (id ('.' name)* | str) (@b:Module | Semi)
Interface = 'interface' id TypeParams? ('extends' TypeRef (',' TypeRef)*)? @b:TypeMembers
Enum = (EnumOne (',' EnumOne)* ','?)?
EnumOne = PropName ('=' Assign)?]]
"""
)

_GO = """
File = Head Imported Tops
Head = 'package' id ';'
Imported = (Import ';')*
Tops = (TopDecl ';')*
Import = 'import' (ImportOne | @p:Imports)
Imports = (ImportOne (';' ImportOne)* ';'?)?
ImportOne = ('.' | id)? str
TopDecl = Decl | Func
Decl = 'const' (ConstOne | @p:Consts) | 'var' (VarOne | @p:Vars) | 'type' (TypeOne | @p:Types)
Consts = (ConstOne (';' ConstOne)* ';'?)?
ConstOne = Ids (Type? '=' Exprs)?
Vars = (VarOne (';' VarOne)* ';'?)?
VarOne = Ids (Type ('=' Exprs)? | '=' Exprs)
Types = (TypeOne (';' TypeOne)* ';'?)?
TypeOne = id @s:TypeParams? '='? Type
TypeParams = TypeParam (',' TypeParam)* ','?
TypeParam = Ids Constraint
Constraint = '~'? Type ('|' '~'? Type)*
Ids = id (',' id)*
Func = 'func' @p:Params? id @s:TypeParams? @p:Params Result? @b:Stmts?
Result = @p:Params | Type
Params = (Param (',' Param)* ','?)?
Param = Type | id '...'? Type | '...' Type
Type = id ('.' id)? @s:TypeArgs? | '*' Type | @p:Type | @s:ArrayLen Type | 'map' @s:Type Type | 'chan' '<-'? Type | '<-' 'chan' Type | 'func' @p:Params Result? | 'struct' @b:Fields | 'interface' @b:Methods
TypeArgs = Type (',' Type)* ','?
ArrayLen = (Expr | '...')?
Fields = (Field (';' Field)* ';'?)?
Field = (Ids Type | '*'? id ('.' id)? @s:TypeArgs?) str?
Methods = (MethodSpec (';' MethodSpec)* ';'?)?
MethodSpec = id @p:Params Result? | Constraint
Stmts = (Stmt? ';')* Stmt?
Stmt = Decl | id ':' Stmt? | Simple | 'go' Expr | 'defer' Expr | 'return' Exprs? | 'break' id? | 'continue' id? | 'goto' id | 'fallthrough' | @b:Stmts | If | Switch | 'select' @b:Cases | For
Simple = Exprs (('=' | ':=' | '+=' | '-=' | '*=' | '/=' | '%=' | '&=' | '|=' | '^=' | '<<=' | '>>=' | '&^=') Exprs)? | Expr ('++' | '--') | Expr '<-' Expr
If = 'if' (Simple? ';')? Expr @b:Stmts ('else' (If | @b:Stmts))?
Switch = 'switch' (Simple? ';')? (Expr | Simple | id ':=' Expr)? @b:Cases
Cases = (('case' CaseHead | 'default') ':' Stmts)*
CaseHead = Simple | CaseItem (',' CaseItem)*
CaseItem = Expr | Type
For = 'for' (Expr | Simple? ';' Expr? ';' Simple? | (Exprs ('=' | ':='))? 'range' Expr)? @b:Stmts
Exprs = Expr (',' Expr)*
Expr = Operand (Binary Operand)*
Binary = '||' | '&&' | '==' | '!=' | '<' | '<=' | '>' | '>=' | '+' | '-' | '|' | '^' | '*' | '/' | '%' | '<<' | '>>' | '&' | '&^'
Operand = Prefix* Postfix
Prefix = '+' | '-' | '!' | '^' | '*' | '&' | '<-' | '~'
Postfix = Primary Suffix*
Suffix = '.' (id | @p:TypeOrType) | @s:Index | @p:Args | @b:Literal
TypeOrType = Type | 'type'
Index = (Expr? ':' Expr? (':' Expr)?) | TypeArgs | Expr ','?
Args = ((Expr | Type) (',' (Expr | Type))* '...'? ','?)?
Primary = id | num | str | @p:Expr | @p:Type | @s:ArrayLen Type (@b:Literal | @p:Args) | 'map' @s:Type Type (@b:Literal | @p:Args) | 'struct' @b:Fields @b:Literal | 'func' @p:Params Result? @b:Stmts | 'chan' Type @p:Args | 'interface' @b:Methods @p:Args
Literal = (LitItem (',' LitItem)* ','?)?
LitItem = LitValue (':' LitValue)?
LitValue = Expr | @b:Literal
"""

_JAVA = """
File = ';'* Head? Imported Types | Mods 'open'? 'module' Name @b:Directives | Import* Member*
Head = Mods 'package' Name ';'
Imported = (Import | ';')*
Types = (TypeDecl | ';')*
Directives = ((id | 'requires') Mods 'static'? Name (id Name (',' Name)*)? ';')*
Import = 'import' 'static'? 'module'? Name ('.' '*')? ';'
Name = id ('.' id)*
Mods = Mod*
Mod = Annotation | 'public' | 'protected' | 'private' | 'static' | 'abstract' | 'final' | 'native' | 'synchronized' | 'transient' | 'volatile' | 'strictfp' | 'default' | 'sealed' | 'non' '-' 'sealed'
Annotation = '@' Name @p:AnnArgs?
AnnArgs = ((AnnPair (',' AnnPair)*) | AnnValue)?
AnnPair = id '=' AnnValue
AnnValue = Expr | @b:AnnList | Annotation
AnnList = (AnnValue (',' AnnValue)*)? ','?
TypeDecl = Mods (Class | Enum | Interface | Record)
Class = 'class' id TypeParams? ('extends' Type)? ('implements' TypeList)? ('permits' TypeList)? @b:Members
Record = 'record' id TypeParams? @p:Params ('implements' TypeList)? @b:Members
Interface = '@'? 'interface' id TypeParams? ('extends' TypeList)? ('permits' TypeList)? @b:Members
Enum = 'enum' id ('implements' TypeList)? @b:EnumBody
EnumBody = (EnumOne (',' EnumOne)*)? ','? (';' Member*)?
EnumOne = Annotation* id @p:Args? @b:Members?
Members = Member*
Member = ';' | 'static'? @b:Stmts | TypeDecl | Mods TypeParams? (Type | 'void') id @p:Params Dims ('throws' TypeList)? (@b:Stmts | 'default' AnnValue ';' | ';') | Mods TypeParams? id @p:Params ('throws' TypeList)? @b:Stmts | Mods id @b:Stmts | Mods Type Vars ';'
Vars = Var (',' Var)*
Var = id Dims ('=' VarInit)?
VarInit = Expr | @b:ArrayInit
ArrayInit = (VarInit (',' VarInit)*)? ','?
Dims = @s:Empty*
Empty = 
TypeParams = '<' TypeParam (',' TypeParam)* '>'
TypeParam = Annotation* id ('extends' Type ('&' Type)*)?
TypeList = Type (',' Type)*
Type = Annotation* (Prim | ClassType) (Annotation* @s:Empty)*
Prim = 'int' | 'long' | 'short' | 'byte' | 'char' | 'boolean' | 'float' | 'double'
ClassType = id TypeArgs? ('.' Annotation* id TypeArgs?)*
TypeArgs = '<' (TypeArg (',' TypeArg)*)? '>'
TypeArg = Type | Annotation* '?' (('extends' | 'super') Type)?
Params = (Param (',' Param)*)?
Param = Mods Type (Annotation* '...')? (id Dims | (id '.')* 'this')
Stmts = Stmt*
Stmt = @b:Stmts | ';' | Mods Type Vars ';' | TypeDecl | Expr ';' | 'if' @p:Expr Stmt ('else' Stmt)? | 'for' @p:ForHead Stmt | 'while' @p:Expr Stmt | 'do' Stmt 'while' @p:Expr ';'
 | 'try' @p:Resources? @b:Stmts ('catch' @p:CatchParam @b:Stmts)* ('finally' @b:Stmts)? | 'switch' @p:Expr @b:Cases | 'synchronized' @p:Expr @b:Stmts | 'return' Expr? ';' | 'throw' Expr ';' | 'break' id? ';' | 'continue' id? ';' | 'yield' Expr ';'
 | 'assert' Expr (':' Expr)? ';' | id ':' Stmt
ForHead = (Mods Type Vars | Exprs)? ';' Expr? ';' Exprs? | Mods Type id Dims ':' Expr
Resources = Resource (';' Resource)* ';'?
Resource = Mods Type id '=' Expr | Expr
CatchParam = Mods Type ('|' Type)* id
Cases = (CaseLabel+ ':' Stmt* | CaseLabel '->' (Expr ';' | @b:Stmts | 'throw' Expr ';'))*
CaseLabel = 'case' CaseItem (',' CaseItem)* ('when' Expr)? | 'default'
CaseItem = Expr | Pattern | 'default'
Pattern = Mods Type id | Type @p:Patterns id?
Patterns = (Pattern (',' Pattern)*)?
Exprs = Expr (',' Expr)*
Expr = Operand (Binary Operand | 'instanceof' (Pattern | Mods Type))* ('?' Expr ':' Expr)? ((Assign) Expr)? | Lambda
Assign = '=' | '+=' | '-=' | '*=' | '/=' | '%=' | '&=' | '|=' | '^=' | '<<=' | '>' '>' '=' | '>' '>' '>' '='
Binary = '==' | '!=' | '<' | '<=' | '>' | '>' '=' | '>' '>' | '>' '>' '>' | '<<' | '+' | '-' | '*' | '/' | '%' | '&' | '|' | '^' | '&&' | '||'
Lambda = (id | @p:LambdaParams) '->' (Expr | @b:Stmts)
LambdaParams = Params | (id (',' id)*)?
Operand = Prefix* (Postfix | Lambda)
Prefix = '+' | '-' | '!' | '~' | '++' | '--' | @p:CastType
CastType = Type ('&' Type)*
Postfix = Primary Suffix*
Suffix = '.' (id | TypeArgs id | 'this' | 'class' | 'super' | New | TypeArgs? 'super' @p:Args) | @s:Expr | @p:Args | '++' | '--' | '::' TypeArgs? (id | 'new')
Primary = id | num | str | 'true' | 'false' | 'null' | 'this' | 'super' | @p:Expr | New | (Prim | 'void') @s:Empty* ('.' 'class' | '::' 'new') | ClassType @s:Empty* ('.' 'class' | '::' (id | 'new')) | 'switch' @p:Expr @b:Cases
New = 'new' Annotation* (Prim | TypeArgs? ClassType) (@p:Args @b:Members? | (@s:Expr)+ @s:Empty* | @s:Empty+ @b:ArrayInit)
Args = (Expr (',' Expr)*)?
"""

_RUST = """
File = InnerAttr* Item*
InnerAttr = '#' '!' @s:Any
Attr = '#' @s:Any
Vis = 'pub' @p:Any? | 'crate'
Item = Attr* Vis? ItemBody | Attr* MacroItem | ';'
Items = InnerAttr* Item*
MacroItem = Path '!' id? (@b:Any | (@p:Any | @s:Any) ';')
ItemBody = Fn | 'mod' id (';' | @b:Items) | 'use' UseTree ';' | 'extern' 'crate' (id | 'self') ('as' id)? ';' | 'type' id Generics? (':' Bounds?)? Where? ('=' Type)? Where? ';' | Struct | Enum | 'union' id Generics? Where? @b:Fields
 | 'const' (id | '_') (':' Type)? ('=' Expr)? ';' | 'static' 'mut'? id ':' Type ('=' Expr)? ';' | 'unsafe'? 'auto'? 'trait' id Generics? (':' Bounds?)? Where? @b:Items
 | 'default'? 'unsafe'? 'impl' Generics? 'const'? '!'? Type ('for' Type)? Where? @b:Items | 'unsafe'? 'extern' str? @b:Items | 'macro_rules' '!' id (@b:Any | (@p:Any | @s:Any) ';') | 'unsafe'? 'mod' id @b:Items
Fn = FnQual* 'fn' id Generics? @p:Params ('->' Type)? Where? (@b:Block | ';')
FnQual = 'const' | 'async' | 'unsafe' | 'extern' str? | 'default' | 'safe' | 'gen'
Params = (Param (',' Param)* ','?)?
Param = Attr* ('&' life? )? 'mut'? 'self' (':' Type)? | Attr* Pat ':' (Type | '...') | Attr* Type | Attr* '...'
UseTree = ('::')? (UseSeg '::')* (UseSeg ('as' (id | '_'))? | '*' | @b:UseTrees)
UseSeg = id | 'self' | 'super' | 'crate' | '$' 'crate'
UseTrees = (UseTree (',' UseTree)* ','?)?
Struct = 'struct' id Generics? (Where? @b:Fields | @p:TupleFields Where? ';' | Where? ';')
Fields = (NamedField (',' NamedField)* ','?)?
NamedField = Attr* Vis? id ':' Type ('=' Expr)?
TupleFields = (TupleField (',' TupleField)* ','?)?
TupleField = Attr* Vis? Type
Enum = 'enum' id Generics? Where? @b:Variants
Variants = (Variant (',' Variant)* ','?)?
Variant = Attr* Vis? id (@p:TupleFields | @b:Fields)? ('=' Expr)?
Generics = '<' (Generic (',' Generic)* ','?)? '>'
Generic = Attr* (life (':' (life ('+' life)* '+'?)?)? | id (':' Bounds?)? ('=' Type)? | 'const' id ':' Type ('=' (@b:Block | '-'? num | Lit | id))?)
Bounds = Bound ('+' Bound)* '+'?
Bound = life | '~'? 'const'? '?'? ForLife? ('async' | '!')? Path | @p:Bounds | 'use' GenericArgs
ForLife = 'for' Generics
Where = 'where' (WhereOne (',' WhereOne)* ','?)?
WhereOne = life ':' (life ('+' life)* '+'?)? | ForLife? Type ':' Bounds?
Type = Path | '&' life? ('mut' | 'const')? Type | '&&' life? 'mut'? Type | '*' ('const' | 'mut') Type | @s:ArrayType | @p:Tuple | '!' | '_' | 'impl' Bounds | 'dyn' Bounds | ForLife? FnQual* 'fn' @p:FnTypeParams ('->' Type)? | QPath | Path '!' (@p:Any | @s:Any | @b:Any) | ForLife Path | Bound '+' Bounds
FnTypeParams = (FnTypeParam (',' FnTypeParam)* ','?)?
FnTypeParam = Attr* ((id | '_') ':')? (Type | '...')
ArrayType = Type (';' Expr)?
Tuple = (Type (',' Type)* ','?)? | Bounds
Path = '::'? PathSeg ('::' PathSeg)*
PathSeg = (id | 'self' | 'super' | 'crate' | 'Self' | '$' 'crate') ('::'? GenericArgs | '::'? @p:Tuple ('->' Type)?)?
GenericArgs = '<' (GenericArg (',' GenericArg)* ','?)? '>'
GenericArg = life | Type | @b:Block | '-'? num | Lit | id GenericArgs? ('=' Type | ':' Bounds)
QPath = '<' Type ('as' Path)? '>' '::' PathSeg ('::' PathSeg)*
Lit = num | str | 'true' | 'false'
Pat = '|'? PatOne ('|' PatOne)*
PatOne = ('ref'? 'mut'? id) ('@' PatOne)? | '-'? Lit | PatRange | '_' | '..' | '&' 'mut'? PatOne | '&&' 'mut'? PatOne | (Path | QPath) (@p:Pats | @b:PatFields)? | @p:Pats | @s:Pats | Path '!' (@p:Any | @s:Any | @b:Any) | 'box' PatOne | 'const' @b:Block
PatRange = PatEnd ('..=' | '...' | '..') PatEnd? | ('..=' | '..') PatEnd
PatEnd = '-'? Lit | Path | QPath
Pats = (Pat (',' Pat)* ','?)?
PatFields = (PatField (',' PatField)* ','?)?
PatField = Attr* ('..' | (id | num) ':' Pat | 'box'? 'ref'? 'mut'? id)
Block = InnerAttr* Stmt* Expr?
Stmts = Stmt*
Stmt = ';' | Item | Attr* 'let' Pat (':' Type)? ('=' Expr ('else' @b:Block)?)? ';' | Attr* Expr ';' | Attr* BlockLike | Attr* Path '!' @b:Any
BlockLike = (life ':')? ('unsafe' | 'const' | 'async' 'move'? | 'try')? @b:Block | 'if' Expr @b:Block ('else' 'if' Expr @b:Block)* ('else' @b:Block)? | 'match' Expr @b:Arms | (life ':')? 'loop' @b:Block | (life ':')? 'while' Expr @b:Block | (life ':')? 'for' Pat 'in' Expr @b:Block
Arms = InnerAttr* (Arm (Arm)*)?
Arm = Attr* Pat ('if' Expr)? '=>' (Expr ',' | BlockLike ','? | Expr)
Expr = Attr* (Operand? RangeOp)? Operand (Binary Operand)* (RangeOp (Operand (Binary Operand)*)?)? | RangeOp | Operand (Binary Operand)* RangeOp
RangeOp = '..' | '..='
Binary = '+' | '-' | '*' | '/' | '%' | '&' | '|' | '^' | '<<' | '>' '>' | '==' | '!=' | '<' | '>' | '<=' | '<' '=' | '>' '=' | '&&' | '||' | '=' | '+=' | '-=' | '*=' | '/=' | '%=' | '&=' | '|=' | '^=' | '<<=' | '>' '>' '='
Operand = Prefix* Postfix | Closure | 'return' Expr? | 'break' life? Expr? | 'continue' life? | 'let' Pat '=' Operand | 'yield' Expr? | Prefix+ Closure
Prefix = '-' | '!' | '*' | '&' ('raw' ('const' | 'mut'))? 'mut'? | '&&' 'mut'? | 'box'
Closure = ForLife? 'static'? 'async'? 'move'? ('||' | '|' (CloParam (',' CloParam)* ','?)? '|') ('->' Type)? Expr
CloParam = Attr* PatOne (':' Type)?
Postfix = Primary Suffix*
Suffix = '?' | '.' (id | num | 'await') ('::' GenericArgs)? | @p:Args | @s:Expr | 'as' Type
Args = (Expr (',' Expr)* ','?)?
Primary = Lit | Path | QPath | (Path | QPath) @b:StructInit | Path '!' (@p:Any | @s:Any | @b:Any) | @p:Args | @s:ArrayInit | BlockLike | '_'
StructInit = (FieldInit (',' FieldInit)*)? (','? '..' Expr)? ','? | '..'
FieldInit = Attr* ((id | num) (':' Expr)?)
ArrayInit = (Expr (',' Expr)* ','?)? | Expr ';' Expr
"""

_PYTHON = """
File = Stmt*
Stmts = Stmt*
Stmt = Simple | Compound | nl
Simple = Small (';' Small)* ';'? nl
Small = Stars | Targets Assign | Target ':' Expr ('=' AssignRight)? | 'del' Targets | 'pass' | 'break' | 'continue' | 'return' Stars? | 'raise' (Expr ('from' Expr)?)? | 'global' Ids | 'nonlocal' Ids | 'assert' Expr (',' Expr)? | Import | 'type' id @s:TypeParams? '=' Expr
Assign = Aug AssignRight | '=' (Targets '=')* AssignRight
Targets = OneTarget (',' OneTarget)* ','?
OneTarget = '*'? Target
Target = id | @p:TargetGroup | @s:TargetGroup | Primary Suffix* ('.' id | @s:Index)
TargetGroup = Targets?
AssignRight = Stars | Yield
Aug = '+=' | '-=' | '*=' | '/=' | '//=' | '%=' | '@=' | '&=' | '|=' | '^=' | '>>=' | '<<=' | '**='
Ids = id (',' id)*
Import = 'import' Dotted ('as' id)? (',' Dotted ('as' id)?)* | 'from' ('.' | '...')* Dotted? 'import' ('*' | ImportNames | @p:ImportParen)
ImportNames = id ('as' id)? (',' id ('as' id)?)*
ImportParen = ImportNames ','?
Dotted = id ('.' id)*
Compound = 'async'? Def | 'if' Named ':' Body ('elif' Named ':' Body)* Else? | 'while' Named ':' Body Else? | 'async'? 'for' Targets 'in' Stars ':' Body Else? | 'async'? 'with' (WithItems | @p:WithParen) ':' Body
 | 'try' ':' Body (Except+ Else? ('finally' ':' Body)? | 'finally' ':' Body) | Decorator+ ('async'? Def | Class) | Class | 'match' Stars ':' nl @i:MatchCases
Else = 'else' ':' Body
Except = 'except' '*'? (Expr (',' Expr)* ('as' id)?)? ':' Body
Body = Simple | nl @i:Stmts
Decorator = '@' Named nl
Def = 'def' id @s:TypeParams? @p:Params ('->' Expr)? ':' Body
Class = 'class' id @s:TypeParams? @p:Args? ':' Body
TypeParams = TypeParam (',' TypeParam)* ','?
TypeParam = ('*' | '**')? id (':' Expr)? ('=' Star)?
WithItems = WithItem (',' WithItem)*
WithParen = WithItems ','?
WithItem = Expr ('as' Target)?
MatchCases = ('case' Patterns ('if' Named)? ':' Body)+
Patterns = Pattern (',' Pattern)* ','?
Pattern = '*' id | OrPattern ('as' id)?
OrPattern = ClosedPattern ('|' ClosedPattern)*
ClosedPattern = '-'? num (('+' | '-') num)? | str+ | 'None' | 'True' | 'False' | id ('.' id)* @p:PatternArgs? | @p:PatternGroup | @s:PatternGroup | @b:PatternMap
PatternGroup = Patterns?
PatternArgs = (PatternArg (',' PatternArg)* ','?)?
PatternArg = Pattern | id '=' Pattern
PatternMap = (PatternPair (',' PatternPair)* ','?)?
PatternPair = ClosedPattern ':' Pattern | '**' id
Params = (Param (',' Param)* ','?)?
Param = id (':' Star)? ('=' Expr)? | '*' (id (':' Star)?)? | '**' id (':' Expr)? | '/'
LambdaParams = (LambdaParam (',' LambdaParam)* ','?)?
LambdaParam = id ('=' Expr)? | '*' id? | '**' id | '/'
Stars = Star (',' Star)* ','? | Yield
Star = '*' Expr | Named
Yield = 'yield' ('from' Expr | Stars)?
Named = (id ':=')? Expr
Expr = Operand (Binary Operand)* ('if' Expr 'else' Expr)? | Lambda | Operand (Binary Operand)* Tail Lambda
Tail = 'or' | 'and'
Lambda = 'lambda' LambdaParams ':' Expr
Binary = 'or' | 'and' | 'in' | 'not' 'in' | 'is' | 'is' 'not' | '<' | '>' | '==' | '>=' | '<=' | '!=' | '|' | '^' | '&' | '<<' | '>>' | '+' | '-' | '*' | '/' | '//' | '%' | '@' | '**'
Operand = ('not' | '+' | '-' | '~' | 'await')* Primary Suffix*
Suffix = '.' id | @p:Args | @s:Index
Primary = id | num | str+ | 'None' | 'True' | 'False' | '...' | @p:Group | @s:List | @b:Dict
Group = Stars? | Named CompFor
List = Stars? | (Star) CompFor
Dict = (DictItem (',' DictItem)* ','?)? | Expr ':' Expr CompFor | Star CompFor
DictItem = Expr ':' Expr | '**' Expr | Star
CompFor = ('async'? 'for' Targets 'in' CompIter ('if' CompIter)*)+
CompIter = Operand (Binary Operand)* ('if' Expr 'else' Expr)? | Lambda | Named
Args = (Given (',' Given)* (',' Keyed)* (',' Last)* ','? | Keyed (',' Keyed)* (',' Last)* ','? | Last (',' Last)* ','?)?
Given = Named CompFor? | '*' Expr
Keyed = id '=' Expr | '*' Expr
Last = id '=' Expr | '**' Expr
Index = IndexOne (',' IndexOne)* ','?
IndexOne = Star | Expr? ':' Expr? (':' Expr?)?
"""

_TS_WORDS = "type interface namespace module declare abstract readonly public private protected implements keyof infer is asserts satisfies override unique global require out as".split()
_JS_FREE = "let static yield await async of get set from as accessor using assert".split()
_RUST_FREE = "union default auto macro_rules safe raw gen box try".split()
_JAVA_FREE = "module open requires record sealed permits non when yield".split()


def _ecma(ts: bool) -> Grammar:
    text = "".join(p for part in _ECMA.split("[[") for p in ([part] if "]]" not in part else _cut(part, ts)))
    free = [*_JS_FREE, *(_TS_WORDS if ts else [])]
    words = "break case catch class const continue debugger default delete do else enum export extends false finally for function if import in instanceof new null return super switch this throw true try typeof var void while with".split()
    groups = {
        "p": ["Expr", "Args", "Params", "ForHead", "CatchParam", *(["Type"] if ts else [])],
        "s": ["Expr", "Elements", "BindList", "Assign", *(["TypeIndex", "TupleElems", "IndexKey", "MappedKey"] if ts else [])],
        "b": ["Stmts", "Object", "Members", "Cases", "BindProps", "Specifiers", *(["Module", "TypeMembers", "Enum"] if ts else [])],
        "e": ["Expr", *(["Type"] if ts else [])],
    }
    commas = {"Args": "Element,!", "Elements": "Element,!", "Object": "Prop,!", "Params": "Param,!", **({"Enum": "EnumOne,!", "TupleElems": "TupleElem,!"} if ts else {})}
    return Grammar(text, {"id": free, "name": [*free, *words, "id", "priv"], "priv": [], "num": [], "str": [], "regex": [], "tmpl": [], "tend": []}, groups, {"script": "Script", "module": "Module"}, ["Module", "Script", "Stmts", "Members", *(["TypeMembers"] if ts else [])], commas, ["else", "catch", "finally", ".", ")", "(", ",", "=", "+", "-", "*", "?", ":", "&&", "||", "from", "as"])


def _cut(part: str, ts: bool) -> list[str]:
    inside, _, rest = part.partition("]]")
    return [inside if ts else "", rest]


@cache
def grammar(lang: str) -> Grammar:
    if lang in ("javascript", "typescript"):
        return _ecma(lang == "typescript")
    if lang == "go":
        groups = {"p": ["Imports", "Consts", "Vars", "Types", "Params", "Type", "Expr", "Args", "TypeOrType"], "s": ["TypeParams", "TypeArgs", "ArrayLen", "Type", "Index"], "b": ["Stmts", "Fields", "Methods", "Cases", "Literal"]}
        return Grammar(_GO, {"id": [], "num": [], "str": []}, groups, {"go": "File"}, ["Stmts", "File:Head,Imported,Tops"], {"Literal": "LitItem,!", "Args": "Expr,", "TypeArgs": "Type,!"}, apart="break continue fallthrough return ++ --".split())
    if lang == "java":
        groups = {"p": ["AnnArgs", "Params", "Args", "Expr", "ForHead", "Resources", "CatchParam", "LambdaParams", "CastType", "Patterns"], "s": ["Empty", "Expr"], "b": ["Members", "EnumBody", "Stmts", "Cases", "ArrayInit", "AnnList", "Directives"]}
        return Grammar(_JAVA, {"id": _JAVA_FREE, "num": [], "str": []}, groups, {"java": "File"}, ["Members", "Stmts", "File:Head,Imported,Types"], {"ArrayInit": "VarInit,!", "AnnList": "AnnValue,!", "Args": "Expr!", "Params": "Param!"}, ["else", "catch", "finally", ".", ","])
    if lang == "rust":
        groups = {"p": ["Params", "TupleFields", "FnTypeParams", "Tuple", "Bounds", "Pats", "Args"], "s": ["ArrayType", "Pats", "Expr", "ArrayInit"], "b": ["Items", "Fields", "UseTrees", "Variants", "Block", "PatFields", "Arms", "StructInit"]}
        words = "as break const continue crate dyn else enum extern false fn for if impl in let loop match mod move mut pub ref return self Self static struct super trait true type unsafe use where while async await yield".split()
        return Grammar(_RUST, {"id": _RUST_FREE, "num": [], "str": [], "life": []}, groups, {"rust": "File"}, ["File", "Items", "Block:Stmts"], {"ArrayInit": "Expr,", "Args": "Expr,!", "Pats": "Pat,!", "Fields": "NamedField,!", "Params": "Param,!", "Variants": "Variant,!", "StructInit": "FieldInit,"}, ["else", ".", "?", ","])
    groups = {"p": ["ImportParen", "WithParen", "Params", "Args", "Group", "PatternArgs", "PatternGroup", "TargetGroup"], "s": ["TypeParams", "Index", "List", "PatternGroup", "TargetGroup"], "b": ["Dict", "PatternMap"], "i": ["Stmts", "MatchCases"]}
    return Grammar(_PYTHON, {"id": ["match", "case", "type"], "num": [], "str": [], "nl": []}, groups, {"python": "File"}, ["File", "Stmts"], {"List": "Star,", "Index": "IndexOne,!", "PatternGroup": "Pattern,!", "Dict": "DictItem,", "Params": "Param,!", "Group": "Star,", "PatternArgs": "PatternArg,!"}, ["elif", "else", "except", "finally"], ["nl"], "i")
