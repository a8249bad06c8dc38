"""Grammars and token rules of the languages whose files are checked for syntax.

Binary operators are written as flat lists: only acceptance matters here, not the shape of the tree.
"""

JAVA = r"""
Java8 = Package? Import* Type* ;
Java17 = Package? Import* TypeN* ;
Module = Import* Annot* 'open'? 'module' QName ModBody ;
Package = Annot* 'package' QName ';' ;
Import = 'import' 'static'? QName ('.' '*')? ';' | ';' ;
QName = Id ('.' Id)* ;
Id = ID | 'record' | 'sealed' | 'permits' | 'var' | 'yield' | 'module' | 'open' | 'with' | 'to' | 'exports' | 'requires' ;
ModBody := '{' ModStmt* '}' ;
ModStmt = ('requires' | 'exports' | 'open' | 'with' | 'to' | Id) ('static' | QName | ',' )* ';' ;
Mod = 'public' | 'private' | 'protected' | 'static' | 'final' | 'abstract' | 'native' | 'synchronized' | 'transient' | 'volatile' | 'strictfp' | 'default' | Annot ;
ModN = Mod | 'sealed' | 'non' '-' 'sealed' ;
Annot = '@' QName AnnArgs? ;
AnnArgs := '(' (AnnPair (',' AnnPair)* | AnnVal)? ')' ;
AnnPair = Id '=' AnnVal ;
AnnVal = Ternary | Annot | AnnArr ;
AnnArr := '{' (AnnVal (',' AnnVal)*)? ','? '}' ;
Type = Mod* (Class | Interface | Enum | AnnType) | ';' ;
TypeN = ModN* (Class | Interface | Enum | AnnType | Record) | ';' ;
Class = 'class' Id TParams? ('extends' Ref)? ('implements' Refs)? ('permits' Refs)? ClassBody ;
Interface = 'interface' Id TParams? ('extends' Refs)? ('permits' Refs)? ClassBody ;
Enum = 'enum' Id ('implements' Refs)? EnumBody ;
Record = 'record' Id TParams? RecHead ('implements' Refs)? ClassBody ;
AnnType = '@' 'interface' Id ClassBody ;
RecHead := '(' (RecPart (',' RecPart)*)? ')' ;
RecPart = Annot* TypeRef '...'? Id ;
Refs = Ref (',' Ref)* ;
TParams = '<' TParam (',' TParam)* '>' ;
TParam = Annot* Id ('extends' Ref ('&' Ref)*)? ;
TypeRef = Annot* (Prim | Ref) Dim* ;
Ref = Id TArgs? ('.' Annot* Id TArgs?)* ;
Prim = 'int' | 'long' | 'char' | 'byte' | 'short' | 'boolean' | 'float' | 'double' ;
TArgs = '<' (TArg (',' TArg)*)? '>' ;
TArg = TypeRef | Annot* '?' (('extends' | 'super') TypeRef)? ;
Dim := '[' ']' ;
ClassBody := '{' Member* '}' ;
EnumBody := '{' (EnumItem (',' EnumItem)*)? ','? (';' Member*)? '}' ;
EnumItem = Annot* Id Args? ClassBody? ;
Member = ModN* Decl | 'static'? Block | ';' ;
Decl = TParams? (TypeRef | 'void') Id Params Dim* Throws? (Block | ('default' AnnVal)? ';') | TParams? Id Params Throws? Block | Id Block
     | TypeRef Vars ';' | Class | Interface | Enum | AnnType | Record ;
Throws = 'throws' Refs ;
Params := '(' (Param (',' Param)*)? ')' ;
Param = Mod* TypeRef '...'? (Id Dim* | Id '.' 'this' | 'this') ;
Vars = Var (',' Var)* ;
Var = Id Dim* ('=' Init)? ;
Init = Expr | ArrInit ;
ArrInit := '{' (Init (',' Init)*)? ','? '}' ;
Block := '{' Stmt* '}' ;
Stmt = Block | ';' | Mod* TypeRef Vars ';' | Mod* (Class | Interface | Enum | Record) | StmtExpr ';'
     | 'if' Cond Stmt ('else' Stmt)? | 'while' Cond Stmt | 'do' Stmt 'while' Cond ';' | 'for' ForHead Stmt
     | 'switch' Cond (SwBody | SwArrows) | 'try' ResHead? Block Catch* ('finally' Block)? | 'return' Expr? ';' | 'throw' Expr ';'
     | 'break' Id? ';' | 'continue' Id? ';' | 'synchronized' Cond Block | 'assert' Expr (':' Expr)? ';' | Id ':' Stmt | 'yield' Expr ';' ;
Cond := '(' Expr ')' ;
ForHead := '(' (Mod* TypeRef Vars | StmtExprs)? ';' Expr? ';' StmtExprs? ')' | '(' Mod* TypeRef Id ':' Expr ')' ;
StmtExprs = StmtExpr (',' StmtExpr)* ;
ResHead := '(' Res (';' Res)* ';'? ')' ;
Res = Mod* TypeRef Id '=' Expr | Postfix ;
Catch = 'catch' CatchHead Block ;
CatchHead := '(' Mod* Ref ('|' Ref)* Id ')' ;
SwBody := '{' (SwLabel+ Stmt*)* '}' ;
SwLabel = 'case' CaseVals ':' | 'default' ':' ;
CaseVals = Pattern (',' Pattern)* ;
Pattern = Ternary | Mod* TypeRef Id | 'default' ;
SwArrows := '{' SwRule* '}' ;
SwRule = ('case' CaseVals | 'default') '->' (Expr ';' | Block | 'throw' Expr ';') ;
StmtExpr = Postfix AssignOp Expr | ('++' | '--') Unary | Primary Suffix* Args | Primary Suffix* ('++' | '--') | New ;
AssignOp = '=' | '+=' | '-=' | '*=' | '/=' | '%=' | '&=' | '|=' | '^=' | '<<=' | '>' '>=' | '>' '>' '>=' ;
Expr = Ternary (AssignOp Expr)? | Lambda ;
Ternary = Bin ('?' Expr ':' (Ternary | Lambda))? ;
Bin = Unary (BinOp Unary | 'instanceof' Mod* TypeRef Id?)* ;
BinOp = '+' | '-' | '*' | '/' | '%' | '&' | '|' | '^' | '&&' | '||' | '==' | '!=' | '<' | '>' | '<=' | '>=' | '<<' | '>' '>' | '>' '>' '>' ;
Unary = ('+' | '-' | '!' | '~' | '++' | '--') Unary | Cast Unary | Cast Lambda | Postfix | 'switch' Cond (SwBody | SwArrows) ;
Cast := '(' TypeRef ('&' TypeRef)* ')' ;
Postfix = Primary Suffix* ('++' | '--')* ;
Suffix = '.' TArgs? Id | '.' 'new' Creator | '.' 'class' | '.' 'this' | '.' 'super' | Args | Index | '::' TArgs? (Id | 'new') ;
Primary = NUM | STR | 'true' | 'false' | 'null' | Id | 'this' | 'super' | Paren | New | Prim Dim* '.' 'class' | 'void' '.' 'class'
        | Ref Dim+ ('.' 'class' | '::' 'new') | Prim Dim+ '::' 'new' | Id TArgs '::' (Id | 'new') ;
Paren := '(' Expr ')' ;
Args := '(' (Expr (',' Expr)*)? ')' ;
Index := '[' Expr ']' ;
New = 'new' Creator ;
Creator = TArgs? Annot* Ref (Args ClassBody?) | Annot* (Prim | Ref) (Index+ Dim* | Dim+ ArrInit) ;
Lambda = (Id | LamHead) '->' (Expr | Block) ;
LamHead := '(' (Id (',' Id)* | Param (',' Param)*)? ')' ;
"""

GO = r"""
File = 'package' ID ';' Import* Top* ;
Import = 'import' (ImpSpec | ImpList) ';' ;
ImpList := '(' (ImpSpec (';' ImpSpec)* ';'?)? ')' ;
ImpSpec = (ID | '.')? STR ;
Top = (Const | Vars | TypeD | Func) ';' | ';' ;
Const = 'const' (ConstSpec | ConstList) ;
ConstList := '(' (ConstSpec (';' ConstSpec)* ';'?)? ')' ;
ConstSpec = Names (Type? '=' Exprs)? ;
Names = ID (',' ID)* ;
Vars = 'var' (VarSpec | VarList) ;
VarList := '(' (VarSpec (';' VarSpec)* ';'?)? ')' ;
VarSpec = Names (Type ('=' Exprs)? | '=' Exprs) ;
TypeD = 'type' (TypeSpec | TypeList) ;
TypeList := '(' (TypeSpec (';' TypeSpec)* ';'?)? ')' ;
TypeSpec = ID TypePs? '='? Type ;
TypePs := '[' TypeP (',' TypeP)* ','? ']' ;
TypeP = Names Constr ;
Constr = '~'? Type ('|' '~'? Type)* ;
Type = ID TypeAs? | ID '.' ID TypeAs? | '*' Type | TParen | Slice Type | ArrLen Type | 'map' MapKey Type | 'chan' '<-'? Type | '<-' 'chan' Type
     | 'func' Sig | 'struct' StructB | 'interface' IfaceB ;
TypeAs := '[' Type (',' Type)* ','? ']' ;
TParen := '(' Type ')' ;
Slice := '[' ']' ;
ArrLen := '[' (Expr | '...') ']' ;
MapKey := '[' Type ']' ;
StructB := '{' (FieldD (';' FieldD)* ';'?)? '}' ;
FieldD = Names Type STR? | '*'? ID ('.' ID)? TypeAs? STR? ;
IfaceB := '{' (IfaceM (';' IfaceM)* ';'?)? '}' ;
IfaceM = ID Sig | Constr ;
Func = 'func' Recv? ID TypePs? Sig Block? ;
Recv := '(' ID? '*'? ID TypeAs? ','? ')' ;
Sig = Params (Params | Type)? ;
Params := '(' (ParamD (',' ParamD)* ','?)? ')' ;
ParamD = ID? '...'? Type ;
Block := '{' Line* Stmt? '}' ;
Line = Stmt? ';' ;
Stmt = Const | Vars | TypeD | ID ':' Stmt? | Simple | 'go' Expr | 'defer' Expr | 'return' Exprs? | 'break' ID? | 'continue' ID? | 'goto' ID | 'fallthrough'
     | Block | If | Switch | Select | For ;
Simple = Expr | Expr ('++' | '--') | Exprs AssOp Exprs | Exprs ':=' Exprs | Expr '<-' Expr ;
AssOp = '=' | '+=' | '-=' | '*=' | '/=' | '%=' | '&=' | '|=' | '^=' | '<<=' | '>>=' | '&^=' ;
If = 'if' (Simple? ';')? Expr Block ('else' (If | Block))? ;
Switch = 'switch' (Simple? ';')? SwGuard? SwBody ;
SwGuard = Expr | ID ':=' Expr ;
SwBody := '{' Case* '}' ;
Case = ('case' CaseVals | 'default') ':' Line* Stmt? ;
CaseVals = CaseVal (',' CaseVal)* ;
CaseVal = Expr | Type ;
Select = 'select' SelBody ;
SelBody := '{' SelCase* '}' ;
SelCase = ('case' Simple | 'case' Exprs ('=' | ':=') Expr | 'default') ':' Line* Stmt? ;
For = 'for' ForHead? Block ;
ForHead = Expr | Simple? ';' Expr? ';' Simple? | (Exprs (':=' | '='))? 'range' Expr ;
Exprs = Expr (',' Expr)* ;
Expr = Unary (BinOp Unary)* ;
BinOp = '+' | '-' | '*' | '/' | '%' | '&' | '|' | '^' | '&&' | '||' | '==' | '!=' | '<' | '>' | '<=' | '>=' | '<<' | '>>' | '&^' ;
Unary = ('+' | '-' | '!' | '^' | '*' | '&' | '<-') Unary | Primary ;
Primary = Operand Suffix* ;
Suffix = '.' ID | '.' Assert | Index | Args | LitVal ;
Assert := '(' (Type | 'type') ')' ;
Index := '[' (Expr | Expr? ':' Expr? | Expr? ':' Expr ':' Expr | Type (',' Type)* ','?) ']' ;
Args := '(' ((Expr | Type) (',' (Expr | Type))* '...'? ','?)? ')' ;
Operand = NUM | STR | ID | Paren | 'func' Sig Block | LitType LitVal | 'map' MapKey Type | Slice Type | 'chan' Type | 'struct' StructB | 'interface' IfaceB ;
LitType = Slice Type | ArrLen Type | 'map' MapKey Type | 'struct' StructB ;
Paren := '(' (Expr | Type) ')' ;
LitVal := '{' (Elem (',' Elem)* ','?)? '}' ;
Elem = (Val ':')? Val ;
Val = Expr | LitVal ;
"""

# In the ECMAScript text, lines that begin with "T " belong to the typed dialect only, lines that begin with "J " to the plain one.
ECMA = r"""
File = Item* ;
Item = Stmt | Import | Export ;
Import = 'import' (STR | ImpClause 'from' STR) ImpWith? ';' ;
ImpWith = 'with' Obj ;
T ImpClause = 'type'? (Id | Id ',' NsImp | Id ',' Named | NsImp | Named) ;
J ImpClause = Id | Id ',' NsImp | Id ',' Named | NsImp | Named ;
NsImp = '*' 'as' Id ;
Named := '{' (Spec (',' Spec)*)? ','? '}' ;
T Spec = 'type'? (Name | STR) ('as' (Name | STR))? ;
J Spec = (Name | STR) ('as' (Name | STR))? ;
Export = 'export' (Decl | 'default' (Func | Class | Expr ';' | 'abstract' Class) | Named ('from' STR)? ';' | '*' ('as' Name)? 'from' STR ';') ;
T Export = 'export' 'type' Named ('from' STR)? ';' | 'export' '=' Expr ';' | 'import' Id '=' Expr ';' ;
Id = ID | 'async' | 'of' | 'get' | 'set' | 'from' | 'as' | 'type' | 'declare' | 'abstract' | 'readonly' | 'namespace' | 'interface' | 'is' | 'keyof' | 'infer' | 'satisfies' | 'static' | 'enum' | 'implements' | 'asserts' | 'public' | 'private' | 'protected' | 'override' ;
Name = Id | KW | 'import' | 'export' | 'default' | 'function' | 'class' | 'extends' | 'const' | 'let' | 'var' | 'if' | 'else' | 'for' | 'while' | 'do' | 'return' | 'switch' | 'case' | 'break' | 'continue' | 'throw' | 'try' | 'catch' | 'finally' | 'new' | 'delete' | 'typeof' | 'void' | 'in' | 'instanceof' | 'this' | 'super' | 'null' | 'true' | 'false' | 'await' | 'yield' | 'with' | 'debugger' ;
Decl = Func | Class | VarD ';' ;
T Decl = 'abstract' Class | 'declare' (Decl | FuncSig ';' | 'namespace' Name ('.' Name)* NsBody | 'namespace' STR NsBody | 'module' STR NsBody) | 'interface' Id TParams? ('extends' TRefs)? ObjT | 'type' Id TParams? '=' Type ';' | 'const'? 'enum' Id EnumB | 'namespace' Id ('.' Id)* NsBody | FuncSig ';' | Decor+ Decl ;
T NsBody := '{' Item* '}' ;
T EnumB := '{' (EnumI (',' EnumI)*)? ','? '}' ;
T EnumI = (Name | STR) ('=' Assign)? ;
T FuncSig = 'async'? 'function' '*'? Id TParams? Params Ret? ;
Func = 'async'? 'function' '*'? Id? TP Params RT Block ;
T TP = TParams? ;
J TP = ;
T RT = Ret? ;
J RT = ;
T TA = TypeAnn? ;
J TA = ;
Class = Decor* 'class' Id? TP ('extends' LHS TArgsO)? Impl ClassB ;
T Impl = ('implements' TRefs)? ;
J Impl = ;
T TArgsO = TArgs? ;
J TArgsO = ;
Decor = '@' LHS ;
ClassB := '{' Member* '}' ;
Member = ';' | Decor* MMod* ('async'? '*'? | 'get' | 'set') PName Opt TP Params RT (Block | ';') | Decor* MMod* PName Opt TA ('=' Assign)? ';' | 'static' Block ;
T Member = MMod* IndexSig ';' ;
MMod = 'static' ;
T MMod = 'public' | 'private' | 'protected' | 'readonly' | 'abstract' | 'override' | 'declare' ;
T Opt = ('?' | '!')? ;
J Opt = ;
PName = Name | STR | NUM | Computed | PRIV ;
Computed := '[' Assign ']' ;
Params := '(' (Param (',' Param)*)? ','? ')' ;
Param = Decor* PMod '...'? Target OptQ TA ('=' Assign)? ;
T PMod = ('public' | 'private' | 'protected' | 'readonly')* ;
J PMod = ;
T Param = 'this' TypeAnn ;
T OptQ = '?'? ;
J OptQ = ;
Target = Id | ObjPat | ArrPat ;
ObjPat := '{' (PatProp (',' PatProp)*)? ','? '}' ;
PatProp = Id ('=' Assign)? | PName ':' Target ('=' Assign)? | '...' Target ;
ArrPat := '[' (PatEl? (',' PatEl?)*) ']' ;
PatEl = '...'? Target ('=' Assign)? ;
VarD = ('const' | 'let' | 'var') Bind (',' Bind)* ;
Bind = Target Bang TA ('=' Assign)? ;
T Bang = '!'? ;
J Bang = ;
Block := '{' Stmt* '}' ;
Stmt = Block | ';' | Decl | Expr ';' | 'if' Cond Stmt ('else' Stmt)? | 'while' Cond Stmt | 'do' Stmt 'while' Cond ';'? | 'for' 'await'? ForHead Stmt
     | 'switch' Cond SwB | 'try' Block (Catch ('finally' Block)? | 'finally' Block) | 'return' Expr? ';' | 'throw' Expr ';' | 'break' Id? ';' | 'continue' Id? ';' | Id ':' Stmt | 'debugger' ';' ;
Cond := '(' Expr ')' ;
ForHead := '(' (VarD | Expr)? ';' Expr? ';' Expr? ')' | '(' (('const' | 'let' | 'var') Target | LHS) ('of' Assign | 'in' Expr) ')' ;
Catch = 'catch' CatchH? Block ;
CatchH := '(' Target TA ')' ;
SwB := '{' (('case' Expr | 'default') ':' Stmt*)* '}' ;
Expr = Assign (',' Assign)* ;
Assign = Tern | LHS AssOp Assign | Arrow | 'yield' '*'? Assign? ;
AssOp = '=' | '+=' | '-=' | '*=' | '/=' | '%=' | '&=' | '|=' | '^=' | '<<=' | '>>=' | '>>>=' | '**=' | '&&=' | '||=' | '??=' ;
Arrow = 'async'? (Id | ArrowH RT) '=>' (Assign | Block) ;
T Arrow = 'async'? TParams ArrowH RT '=>' (Assign | Block) ;
ArrowH := '(' (Param (',' Param)*)? ','? ')' ;
Tern = Bin ('?' Assign ':' Assign)? ;
Bin = Unary (BinOp Unary)* ;
T Bin = Unary (BinOp Unary | ('as' | 'satisfies') Type | 'as' 'const')* ;
BinOp = '+' | '-' | '*' | '/' | '%' | '**' | '&' | '|' | '^' | '&&' | '||' | '??' | '==' | '!=' | '===' | '!==' | '<' | '>' | '<=' | '>=' | '<<' | '>>' | '>>>' | 'in' | 'instanceof' ;
Unary = ('+' | '-' | '!' | '~' | 'typeof' | 'void' | 'delete' | 'await' | '++' | '--') Unary | LHS ('++' | '--')? ;
T Unary = TCast Unary ;
T TCast = '<' Type '>' ;
LHS = Prim Suffix* ;
Suffix = '.' (Name | PRIV) | '?.' (Name | PRIV | Args | Index) | Args | Index | TPL ;
T Suffix = '!' | TArgs Args ;
Prim = Id | NUM | STR | TPL | REGEX | 'this' | 'super' | 'null' | 'true' | 'false' | Paren | Arr | Obj | Func | Class | 'new' NewT | 'import' Args | 'import' '.' Name | PRIV ;
NewT = '.' Name | 'new' NewT | NewP NewS* TArgsO Args? ;
NewP = Id | 'this' | Paren | Class | Func ;
NewS = '.' Name | Index ;
Paren := '(' Expr ')' ;
Args := '(' (Arg (',' Arg)*)? ','? ')' ;
Arg = '...'? Assign ;
Index := '[' Expr ']' ;
Arr := '[' (Arg? (',' Arg?)*) ']' ;
Obj := '{' (Prop (',' Prop)*)? ','? '}' ;
Prop = Id | Id '=' Assign | PName ':' Assign | '...' Assign | ('async'? '*'? | 'get' | 'set') PName TP Params RT Block ;
T TypeAnn = ':' Type ;
T Ret = ':' ('asserts'? (Id | 'this') 'is' Type | Type) ;
T TParams = '<' TParam (',' TParam)* ','? '>' ;
T TParam = 'const'? Id ('extends' Type)? ('=' Type)? ;
T TArgs = '<' Type (',' Type)* '>' ;
T TRefs = TRef (',' TRef)* ;
T TRef = Id ('.' Name)* TArgs? ;
T Type = UType ('extends' UType '?' Type ':' Type)? | TParams? TParamsG '=>' Ret2 | 'new' TParams? TParamsG '=>' Type ;
T Ret2 = ('asserts'? (Id | 'this') 'is')? Type ;
T TParamsG := '(' (Param (',' Param)*)? ','? ')' ;
T UType = ('|' | '&')? PType (('|' | '&') PType)* ;
T PType = ('keyof' | 'readonly' | 'infer' | 'unique') PType | TBase TSuf* ;
T TSuf = TDim ;
T TDim := '[' Type? ']' ;
T TBase = TRef | 'void' | 'null' | 'this' | 'true' | 'false' | 'typeof' TRef | STR | TPL | '-'? NUM | TParen | ObjT | Tuple | 'import' Args ('.' Name)* TArgs? ;
T TParen := '(' Type ')' ;
T Tuple := '[' (TupEl (',' TupEl)*)? ','? ']' ;
T TupEl = '...'? (Id '?'? ':')? Type '?'? ;
T ObjT := '{' (TMem ((';' | ',') TMem)*)? (';' | ',')? '}' ;
T TMem = 'readonly'? PName '?'? TypeAnn | PName '?'? TParams? TParamsG Ret? | TParams? TParamsG Ret? | 'new' TParams? TParamsG Ret? | IndexSig | ('get' | 'set') PName TParamsG Ret? | MapSig ;
T IndexSig = 'readonly'? IdxKey TypeAnn ;
T IdxKey := '[' Id ':' Type ']' ;
T MapSig = ('+' | '-')? 'readonly'? MapKey ('+' | '-')? '?'? TypeAnn ;
T MapKey := '[' Id 'in' Type ('as' Type)? ']' ;
"""


def ecma(typed: bool) -> str:
    keep = "T " if typed else "J "
    return "\n".join(x[2:] if x[:2] in ("T ", "J ") else x for x in ECMA.splitlines() if x[:2] not in ("T ", "J ") or x[:2] == keep)


# NL ends a logical line; a suite is a {} group made from indentation, a dictionary or set is a DS group.
PYTHON = r"""
Py36 = Line* ;
Py312 = LineN* ;
Line = Simple NL | Compound ;
LineN = Simple NL | Compound | Match | 'type' ID TPs? '=' Expr NL ;
Simple = Small (';' Small)* ';'? ;
Small = Exprs (AugOp (Yield | Exprs) | ('=' (Yield | Exprs))*) | Expr ':' Expr ('=' (Yield | Exprs))? | Yield | 'pass' | 'break' | 'continue' | 'return' Exprs? | 'raise' (Expr ('from' Expr)?)?
      | 'global' Names | 'nonlocal' Names | 'del' Exprs | 'assert' Expr (',' Expr)? | 'import' DName As? (',' DName As?)* | 'from' Dots (ImpNames | ImpParen | '*') ;
Id = ID | 'match' | 'case' | 'type' | '_' ;
Names = Id (',' Id)* ;
DName = Id ('.' Id)* ;
As = 'as' Id ;
Dots = ('.' | '...')+ DName? 'import' | DName 'import' ;
ImpNames = Id As? (',' Id As?)* ;
ImpParen := '(' ImpNames ','? ')' ;
AugOp = '+=' | '-=' | '*=' | '/=' | '//=' | '%=' | '@=' | '&=' | '|=' | '^=' | '<<=' | '>>=' | '**=' ;
Compound = 'if' NExpr Suite ('elif' NExpr Suite)* ('else' Suite)? | 'while' NExpr Suite ('else' Suite)? | 'async'? 'for' Exprs 'in' Exprs Suite ('else' Suite)?
         | 'try' Suite (Except+ ('else' Suite)? ('finally' Suite)? | 'finally' Suite) | 'async'? 'with' WithItems Suite | Deco* ('async'? 'def' Id TPs? Params ('->' Expr)? Suite | 'class' Id TPs? Args? Suite) ;
Deco = '@' NExpr NL ;
Except = 'except' ('*'? Expr ('as' Id)?)? Suite ;
WithItems = WithItem (',' WithItem)* | WithParen ;
WithItem = Expr ('as' Target)? ;
WithParen := '(' WithItem (',' WithItem)* ','? ')' ;
Target = Postfix | '*' Postfix ;
Suite = ':' (Simple NL | NL Body) ;
Body := '{' LineN+ '}' ;
TPs := '[' TPar (',' TPar)* ','? ']' ;
TPar = ('*' | '**')? Id (':' Expr)? ('=' Expr)? ;
Params := '(' (PList ','?)? ')' ;
PList = PBares (',' PDefs)? (',' PRest)? | PDefs (',' PRest)? | PRest ;
PBares = PBare (',' (PBare | '/'))* ;
PDefs = PDef (',' (PDef | '/'))* ;
PBare = Id (':' Expr)? ;
PDef = Id (':' Expr)? '=' Expr ;
PRest = '*' (Id (':' '*'? Expr)?)? (',' (PBare | PDef))* (',' PKeys)? | PKeys ;
PKeys = '**' Id (':' Expr)? ;
LParams = LList ','? ;
LList = LBares (',' LDefs)? (',' LRest)? | LDefs (',' LRest)? | LRest ;
LBares = Id (',' (Id | '/'))* ;
LDefs = LDef (',' (LDef | '/'))* ;
LDef = Id '=' Expr ;
LRest = '*' Id? (',' (Id | LDef))* (',' '**' Id)? | '**' Id ;
Match = 'match' Exprs ':' NL Cases ;
Cases := '{' Case+ '}' ;
Case = 'case' Pats ('if' NExpr)? Suite ;
Pats = Pat (',' Pat)* ','? ;
Pat = '*' Id | POr ('as' Id)? ;
POr = PAtom ('|' PAtom)* ;
PAtom = '-'? NUM (('+' | '-') NUM)? | STR+ | 'None' | 'True' | 'False' | DName PArgs? | PSeqP | PSeqB | PMap ;
PArgs := '(' (PArg (',' PArg)*)? ','? ')' ;
PArg = (Id '=')? Pat ;
PSeqP := '(' Pats? ')' ;
PSeqB := '[' Pats? ']' ;
PMap := '{' (PKV (',' PKV)*)? ','? '}' ;
PKV = ('-'? NUM | STR+ | DName) ':' Pat | '**' Id ;
Exprs = (Star | NExpr) (',' (Star | NExpr))* ','? ;
Star = '*' Bin ;
NExpr = Expr | Id ':=' Expr ;
Expr = Or ('if' Or 'else' Expr)? | 'lambda' LParams? ':' Expr ;
Or = Not (('and' | 'or') Not)* ;
Not = 'not' Not | Comp ;
Comp = Bin (CmpOp Bin)* ;
CmpOp = '<' | '>' | '<=' | '>=' | '==' | '!=' | 'in' | 'not' 'in' | 'is' 'not'? ;
Bin = Un (BinOp Un)* ;
BinOp = '+' | '-' | '*' | '/' | '//' | '%' | '@' | '&' | '|' | '^' | '<<' | '>>' ;
Un = ('+' | '-' | '~') Un | 'await'? Postfix ('**' Un)? ;
Postfix = Atom Suffix* ;
Suffix = '.' Id | Args | Index ;
Atom = Id | NUM | STR+ | 'None' | 'True' | 'False' | '...' | Paren | List | DictSet ;
Yield = 'yield' (Exprs | 'from' Expr)? ;
Paren := '(' (Exprs | Yield | (NExpr | Star) CompFor)? ')' ;
List := '[' (Exprs | (NExpr | Star) CompFor)? ']' ;
DictSet := '{' (KV (',' KV)* ','? | Expr ':' Expr CompFor | Exprs | (NExpr | Star) CompFor)? '}' ;
KV = Expr ':' Expr | '**' Bin ;
CompFor = 'async'? 'for' Exprs 'in' Or CompIter* ;
CompIter = 'async'? 'for' Exprs 'in' Or | 'if' CExpr ;
CExpr = Or | Id ':=' Expr | 'lambda' LParams? ':' Expr ;
Args := '(' (AList ','?)? ')' | '(' NExpr CompFor ')' ;
AList = APos (',' APos)* (',' AKey)* (',' ADicts)? | AKey (',' AKey)* (',' ADicts)? | ADicts ;
APos = NExpr | '*' Expr ;
AKey = Id '=' Expr | '*' Expr ;
ADicts = '**' Expr (',' (Id '=' Expr | '**' Expr))* ;
Index := '[' (Sub (',' Sub)*) ','? ']' ;
Sub = NExpr | Star | Expr? ':' Expr? (':' Expr?)? ;
"""

JSON = r"""
Json = Value ;
Value = STR | NUM | 'true' | 'false' | 'null' | Obj | Arr ;
Obj := '{' (STR ':' Value (',' STR ':' Value)*)? '}' ;
Arr := '[' (Value (',' Value)*)? ']' ;
"""

# { and } stand for a start and an end tag of one name; the lexer pairs the names.
XML = r"""
Doc = DECL? Misc* DOCTYPE? Misc* (Elem | EMPTY) Misc* ;
Misc = COMMENT | PI | WS ;
Elem := '{' (Elem | EMPTY | TEXT | WS | COMMENT | PI | CDATA)* '}' ;
"""

# A line of the shell grammar is a list of words; compound commands are recognised by reserved words at command position.
BASH = r"""
Bash = Sep* List? ;
Posix = Sep* ListP? ;
Sep = ';;NL' ;
List = AndOr (Term AndOr)* Term? ;
ListP = AndOr (Term AndOr)* Term? ;
Term = (';' | '&' | ';;NL') ';;NL'* ;
AndOr = Pipe (('&&' | '||') ';;NL'* Pipe)* ;
Pipe = '!'? Cmd (('|' | '|&') ';;NL'* Cmd)* ;
Cmd = Simple | Comp Redir* | Func | 'time' Pipe ;
Simple = (ASSIGN | Redir)+ (Word (Arg | Redir)*)? | Word (Arg | Redir)* ;
Word = WORD | 'in' ;
Arg = WORD | ASSIGN | 'in' | 'if' | 'then' | 'else' | 'elif' | 'fi' | 'do' | 'done' | 'case' | 'esac' | 'while' | 'until' | 'for' | 'select' | 'function' | '!' | 'time' | ArrayLit ;
ArrayLit := '(' (Arg | ';;NL')* ')' ;
Redir = REDIR (WORD | 'in') | REDIRFD ;
Comp = 'if' Body 'then' Body ('elif' Body 'then' Body)* ('else' Body)? 'fi' | ('while' | 'until') Body 'do' Body 'done' | ('for' | 'select') Name Words? DoSep 'do' Body 'done'
     | 'for' ARITH DoSep 'do' Body 'done' | 'case' Arg ';;NL'* 'in' ';;NL'* CaseItem* LastItem? 'esac' | Brace | Sub | ARITH | COND ;
Name = WORD ;
Words = ';;NL'* 'in' Arg* ;
DoSep = (';' | ';;NL')* ;
Body = ';;NL'* AndOr (Term AndOr)* Term ;
Sub := '(' ';;NL'* List ')' ;
Brace := '{' Body '}' ;
CaseItem = CASEPAT ';;NL'* List? (';;' | ';&') ';;NL'* ;
LastItem = CASEPAT ';;NL'* List? ;
Func = WORD FuncP ';;NL'* Comp Redir* | 'function' WORD FuncP? ';;NL'* Comp Redir* ;
FuncP := '(' ')' ;
"""
