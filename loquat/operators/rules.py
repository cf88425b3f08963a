"""Detection rules as data: call rules, assignment rules, and their joins."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

# Order, rule, kind of callee, callee, argument ("" is the first unlabelled), base confidence, context.
CALL_RULES = [
    (1, "TextView", "direct", "Text", "", 0.98, "textView"),
    (2, "Button", "direct", "Button", "", 0.95, "buttonLabel"),
    (3, "LabelView", "direct", "Label", "", 0.95, "labelView"),
    (4, "Toggle", "direct", "Toggle", "", 0.93, "toggle"),
    (5, "NavigationTitle", "member", "navigationTitle", "", 0.97, "navigationTitle"),
    (5, "NavigationTitle", "member", "navigationBarTitle", "", 0.97, "navigationTitle"),
    (6, "Alert", "member", "alert", "", 0.93, "alert"),
    (7, "ConfirmationDialog", "member", "confirmationDialog", "", 0.93, "confirmationDialog"),
    (8, "TextField", "direct", "TextField", "", 0.92, "textField"),
    (9, "AccessibilityLabel", "member", "accessibilityLabel", "", 0.90, "accessibilityLabel"),
    (10, "Section", "direct", "Section", "", 0.90, "section"),
    (11, "Picker", "direct", "Picker", "", 0.92, "picker"),
    (12, "Menu", "direct", "Menu", "", 0.93, "menu"),
    (13, "DisclosureGroup", "direct", "DisclosureGroup", "", 0.91, "disclosureGroup"),
    (14, "HelpText", "member", "help", "", 0.88, "helpText"),
    (15, "UIButtonSetTitle", "member", "setTitle", "", 0.93, "uiButtonTitle"),
    (16, "UIAlertControllerTitle", "direct", "UIAlertController", "title", 0.96, "uiAlertTitle"),
    (17, "UIAlertControllerMessage", "direct", "UIAlertController", "message", 0.93, "uiAlertMessage"),
    (18, "UIAlertAction", "direct", "UIAlertAction", "title", 0.95, "uiAlertAction"),
    (19, "UIBarButtonItem", "direct", "UIBarButtonItem", "title", 0.93, "uiButtonTitle"),
    (20, "UITabBarItem", "direct", "UITabBarItem", "title", 0.93, "uiTabBarItem"),
]
# Order, property, base confidence, context.
ASSIGNMENT_RULES = [
    (1, "text", 0.88, "uiLabel"),
    (1, "placeholder", 0.88, "uiTextFieldPlaceholder"),
    (1, "title", 0.88, "uiNavigationTitle"),
    (1, "prompt", 0.88, "uiNavigationTitle"),
    (1, "backButtonTitle", 0.88, "uiNavigationTitle"),
]
STATIC_BASE, STATIC_CONTEXT = 0.60, "staticStringConstant"
# Context -> (name shown, suffix of property names).
CONTEXTS = {
    "textView": ("Text", ""),
    "buttonLabel": ("Button", "ButtonTitle"),
    "labelView": ("Label", "Label"),
    "navigationTitle": ("navigationTitle", "NavigationTitle"),
    "alert": ("alert", "AlertTitle"),
    "confirmationDialog": ("confirmationDialog", "DialogTitle"),
    "textField": ("TextField", "Placeholder"),
    "accessibilityLabel": ("accessibilityLabel", "AccessibilityLabel"),
    "toggle": ("Toggle", "ToggleLabel"),
    "section": ("Section", "SectionTitle"),
    "picker": ("Picker", "PickerLabel"),
    "menu": ("Menu", "MenuTitle"),
    "disclosureGroup": ("DisclosureGroup", "SectionTitle"),
    "helpText": ("help", "HelpText"),
    "uiLabel": ("UILabel.text", "Label"),
    "uiButtonTitle": ("UIButton.setTitle", "ButtonTitle"),
    "uiTextFieldPlaceholder": ("UITextField.placeholder", "Placeholder"),
    "uiNavigationTitle": ("UINavigationItem.title", "NavigationTitle"),
    "uiAlertTitle": ("UIAlertController.title", "AlertTitle"),
    "uiAlertMessage": ("UIAlertController.message", "AlertMessage"),
    "uiAlertAction": ("UIAlertAction.title", "ActionTitle"),
    "uiTabBarItem": ("UITabBarItem.title", "TabTitle"),
    "staticStringConstant": ("staticConstant", ""),
}


def call_rules(spark: SparkSession, extra: list[tuple] = ()) -> DataFrame:
    """The built-in rules and a caller's own, in order; a few dozen rows by construction."""
    return spark.createDataFrame([*CALL_RULES, *extra], "ord int, rule string, callee_kind string, callee string, argument string, base double, context string")


def assignment_rules(spark: SparkSession, extra: list[tuple] = ()) -> DataFrame:
    return spark.createDataFrame([*ASSIGNMENT_RULES, *extra], "ord int, property string, base double, context string")


def match_calls(calls: DataFrame, rules: DataFrame) -> DataFrame:
    """Every rule for every call (a call may match several). The rule table is code, so it is broadcast."""
    return calls.join(F.broadcast(rules), ["callee_kind", "callee"])


def match_assignments(assignments: DataFrame, rules: DataFrame) -> DataFrame:
    """The first rule by order for each assignment."""
    first = rules.groupBy("property").agg(F.min_by(F.struct("base", "context"), "ord").alias("r")).select("property", "r.base", "r.context")
    return assignments.join(F.broadcast(first), "property")


def select_argument(args, argument):
    """The first argument without a label if ``argument`` is "", else the first with that label; null if none."""
    return F.try_element_at(F.filter(args, lambda a: F.when(argument == "", a["label"].isNull()).otherwise(F.coalesce(a["label"] == argument, F.lit(False)))), F.lit(1))


def context_name(context):
    table = F.create_map(*[F.lit(x) for k, (shown, _) in CONTEXTS.items() for x in (k, shown)])
    return F.coalesce(F.try_element_at(table, context), context)


def context_suffix(context):
    table = F.create_map(*[F.lit(x) for k, (_, suffix) in CONTEXTS.items() for x in (k, suffix)])
    return F.coalesce(F.try_element_at(table, context), F.lit(""))
