"""Rule tables of resolution: which parent and child types make which edge.

Types are simplified first; a pair without a rule makes no edge.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

# Definition types that count as another one in the rules.
SIMPLE = {
    "Python": {
        "DecoratedClass": "Class", "AsyncMethod": "Method", "DecoratedMethod": "Method", "DecoratedAsyncMethod": "Method",
        "AsyncFunction": "Function", "DecoratedFunction": "Function", "DecoratedAsyncFunction": "Function",
    },
    "TypeScript": {"NamedClassExpression": "Class", "NamedFunctionExpression": "Function", "NamedArrowFunction": "Function", "NamedGeneratorFunctionExpression": "Function", "NamedCallExpression": "Function"},
    "Java": {"Enum": "Class", "AnnotationDeclaration": "Class", "Record": "Class", "Constructor": "Method"},
    "Kotlin": {"DataClass": "Class", "ValueClass": "Class", "AnnotationClass": "Class", "Object": "Class", "CompanionObject": "Class", "Enum": "Class"},
    "CSharp": {
        "Struct": "Class", "Record": "Class", "Enum": "Class", "Delegate": "Class", "AnonymousType": "Class",
        "ExtensionMethod": "StaticMethod", "Operator": "StaticMethod", "Finalizer": "InstanceMethod", "Indexer": "Property",
    },
}
# Parent type, child type, relationship; * is any type.
RULES = {
    "Ruby": """
        Class Method CLASS_TO_METHOD
        Class SingletonMethod CLASS_TO_SINGLETON_METHOD
        Class Class CLASS_TO_CLASS
        Class Lambda CLASS_TO_LAMBDA
        Class Proc CLASS_TO_PROC
        Module Method MODULE_TO_METHOD
        Module SingletonMethod MODULE_TO_SINGLETON_METHOD
        Module Class MODULE_TO_CLASS
        Module Module MODULE_TO_MODULE
    """,
    "Python": """
        Class Class CLASS_TO_CLASS
        Class Method CLASS_TO_METHOD
        Class Lambda CLASS_TO_LAMBDA
        Method Class METHOD_TO_CLASS
        Method Function METHOD_TO_FUNCTION
        Method Lambda METHOD_TO_LAMBDA
        Function Function FUNCTION_TO_FUNCTION
        Function Class FUNCTION_TO_CLASS
        Function Lambda FUNCTION_TO_LAMBDA
        Lambda Lambda LAMBDA_TO_LAMBDA
        Lambda Class LAMBDA_TO_CLASS
        Lambda Function LAMBDA_TO_FUNCTION
    """,
    "TypeScript": """
        Class Class CLASS_TO_CLASS
        Class Method CLASS_TO_METHOD
        Method Class METHOD_TO_CLASS
        Method Function METHOD_TO_FUNCTION
        Function Class FUNCTION_TO_CLASS
        Function Function FUNCTION_TO_FUNCTION
        Interface Class INTERFACE_TO_CLASS
        Interface Function INTERFACE_TO_FUNCTION
    """,
    "Java": """
        Class Class CLASS_TO_CLASS
        Class Interface CLASS_TO_INTERFACE
        Class EnumConstant CLASS_TO_ENUM_ENTRY
        Class Method CLASS_TO_METHOD
        Class Lambda CLASS_TO_LAMBDA
        Interface Interface INTERFACE_TO_INTERFACE
        Interface Class INTERFACE_TO_CLASS
        Interface Method INTERFACE_TO_METHOD
        Interface Lambda INTERFACE_TO_LAMBDA
        Method Method METHOD_TO_METHOD
        Method Class METHOD_TO_CLASS
        Method Interface METHOD_TO_INTERFACE
        Method Lambda METHOD_TO_LAMBDA
        Lambda Lambda LAMBDA_TO_LAMBDA
        Lambda Class LAMBDA_TO_CLASS
        Lambda Method LAMBDA_TO_METHOD
        Lambda Interface LAMBDA_TO_INTERFACE
    """,
    "Kotlin": """
        Class Class CLASS_TO_CLASS
        Class Interface CLASS_TO_INTERFACE
        Class Function CLASS_TO_METHOD
        Class Property CLASS_TO_PROPERTY
        Class Lambda CLASS_TO_LAMBDA
        Class Constructor CLASS_TO_CONSTRUCTOR
        Class EnumEntry CLASS_TO_ENUM_ENTRY
        Interface Interface INTERFACE_TO_INTERFACE
        Interface Class INTERFACE_TO_CLASS
        Interface Function INTERFACE_TO_METHOD
        Interface Property INTERFACE_TO_PROPERTY
        Interface Lambda INTERFACE_TO_LAMBDA
        Function Function METHOD_TO_METHOD
        Function Property METHOD_TO_PROPERTY
        Function Lambda METHOD_TO_LAMBDA
        Function Class METHOD_TO_CLASS
        Function Interface METHOD_TO_INTERFACE
        Lambda Lambda LAMBDA_TO_LAMBDA
        Lambda Class LAMBDA_TO_CLASS
        Lambda Function LAMBDA_TO_METHOD
        Lambda Property LAMBDA_TO_PROPERTY
        Lambda Interface LAMBDA_TO_INTERFACE
    """,
    "CSharp": """
        Class Class CLASS_TO_CLASS
        Class Interface CLASS_TO_INTERFACE
        Class InstanceMethod CLASS_TO_METHOD
        Class StaticMethod CLASS_TO_METHOD
        Class Property CLASS_TO_PROPERTY
        Class Constructor CLASS_TO_CONSTRUCTOR
        Class Lambda CLASS_TO_LAMBDA
        Interface Interface INTERFACE_TO_INTERFACE
        Interface Class INTERFACE_TO_CLASS
        Interface InstanceMethod INTERFACE_TO_METHOD
        Interface Property INTERFACE_TO_PROPERTY
        InstanceMethod InstanceMethod METHOD_TO_METHOD
        StaticMethod StaticMethod METHOD_TO_METHOD
        InstanceMethod Lambda METHOD_TO_LAMBDA
        StaticMethod Lambda METHOD_TO_LAMBDA
    """,
    "Rust": """
        Module * MODULE_TO_SINGLETON_METHOD
        Struct Field CLASS_TO_METHOD
        Enum Variant CLASS_TO_METHOD
        Trait Method CLASS_TO_METHOD
        Impl Method CLASS_TO_METHOD
        Impl AssociatedFunction CLASS_TO_METHOD
        Union Field CLASS_TO_METHOD
    """,
}
#: Types that serve resolution alone and become no node.
HIDDEN = {"Java": ["Package", "LocalVariable", "Parameter", "Field"], "Kotlin": ["Package", "LocalVariable", "Parameter"], "TypeScript": ["Namespace"]}
# Names of a web framework's methods, whose calls resolve nowhere.
FRAMEWORK = (
    "present? blank? nil? respond_to? send instance_eval class_eval define_method attr_reader attr_writer attr_accessor validates "
    "belongs_to has_many has_one before_action after_action render redirect_to params request response session"
).split()
# Kotlin operators and the functions they call, with one operand or with two.
KOTLIN_UNARY = {"+": "unaryPlus", "-": "unaryMinus", "!": "not", "++": "inc", "--": "dec", "[]": "get"}
KOTLIN_BINARY = {
    "+": "plus", "-": "minus", "*": "times", "/": "div", "%": "rem", "..": "rangeTo", "..<": "rangeUntil", "in": "contains", "!in": "contains",
    "+=": "plusAssign", "-=": "minusAssign", "*=": "timesAssign", "/=": "divAssign", "%=": "remAssign",
    "==": "equals", "!=": "equals", ">": "compareTo", "<": "compareTo", ">=": "compareTo", "<=": "compareTo",
}


def rule_table(spark: SparkSession) -> DataFrame:
    """(language, parent_type, child_type, rel_type), a row a rule; the child * is any type."""
    return spark.createDataFrame([(lang, *line.split()) for lang, rules in RULES.items() for line in rules.strip().split("\n")], "language string, parent_type string, child_type string, rel_type string")


def ruled(pairs: DataFrame) -> DataFrame:
    """``pairs`` (language, parent_type, child_type, ...) that a rule allows, with rel_type."""
    rules = F.broadcast(rule_table(pairs.sparkSession))  # a row a rule
    exact = pairs.join(rules.where("child_type <> '*'"), ["language", "parent_type", "child_type"])
    any_ = pairs.join(rules.where("child_type = '*'").drop("child_type"), ["language", "parent_type"])
    return exact.unionByName(any_.select(*exact.columns))


def simple_type(language, type_) -> "F.Column":
    out = type_
    for lang, kinds in SIMPLE.items():
        for a, b in kinds.items():
            if a != b:
                out = F.when((language == lang) & (type_ == a), b).otherwise(out)
    return out


def hidden(language, type_) -> "F.Column":
    out = F.lit(False)
    for lang, kinds in HIDDEN.items():
        out = out | (language == lang) & type_.isin(kinds)
    return out


def framework_call(language, name, receiver_type) -> "F.Column":
    """A Ruby call of a framework method, or on a framework base class."""
    return (language == "Ruby") & (name.isin(FRAMEWORK) | (receiver_type == "ActiveRecord::Base") | F.endswith(receiver_type, F.lit("::Base")))
