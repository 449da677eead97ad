"""Row types and closed value sets of the code model."""

from __future__ import annotations

from pyspark.sql.types import StructType

ELEMENT_TYPES = ("Function", "Struct", "Enum", "Trait", "Impl", "Module", "Constant", "Static", "TypeAlias", "Macro", "Union")
VISIBILITIES = ("Public", "Restricted", "Private")
REFERENCE_TYPES = ("FunctionCall", "TypeUsage", "VariableAccess", "ModuleReference", "TraitImplementation", "GenericUsage", "MacroInvocation", "ImportReference")
CALL_TYPES = ("static", "method", "direct")
RELATIONSHIPS = ("implements", "uses", "references")
LEVELS = ("Low", "Medium", "High", "VeryHigh")
TRAVERSALS = ("Dependencies", "Dependents", "CallChains", "CallersChain", "TypeRelationships")
PHASES = ("PreProcess", "PostFileExtract", "PostProject", "PreFormat", "PostFormat")
SCHEMA_VERSION = 1

ELEMENT_DDL = (
    "project_id string, relative_path string, element_id string, element_type string, name string, qualified_name string, signature string, "
    "visibility string, visibility_scope string, line_start int, line_end int, complexity int, cyclomatic int, cognitive int, nesting_depth int, "
    "parameter_count int, return_count int, lines_of_code int, halstead_n1 int, halstead_n2 int, halstead_total1 int, halstead_total2 int, "
    "doc_comments array<string>, inline_comments array<string>, attributes array<string>, dependencies array<string>, generic_params array<string>, "
    "module_path string, parent_id string, nesting_level int, ordinal int"
)
REFERENCE_DDL = "project_id string, relative_path string, from_element_id string, to_element_id string, reference_type string, reference_text string, line int, scope string, is_resolved boolean"
IMPORT_DDL = "project_id string, relative_path string, module_path string, imported_items array<string>, is_glob boolean, alias string"
FILE_DDL = "project_id string, relative_path string, lines_of_code int, comment_lines int, size_bytes bigint, error string"
PROJECT_DDL = "project_id string, name string, version string, rust_edition string, root_path string"
EDGE_DDL = "project_id string, src string, dst string, kind string, rel_type string, weight double, count bigint, sites array<int>"


def schema(ddl: str) -> StructType:
    return StructType.fromDDL(ddl)
