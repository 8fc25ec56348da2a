"""Activity -> category dictionaries.

The lookup compiles to a literal map expression (no join, no shuffle) when the
dictionary is given as a Python mapping, which is the normal case: it is a
parameter table of a few dozen entries.  A DataFrame mapping is joined without
a hint, whatever its size.
"""

from __future__ import annotations

from collections.abc import Mapping

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

OTHER = "Other"

# The product-trial category dictionary (28 activity names,
# 6 categories), in the order the source lists them.
PRODUCT_CATEGORY_MAP: dict[str, str] = {
    "Scheduling.Availability.Set": "Scheduling_Shifts",
    "Scheduling.Shift.Created": "Scheduling_Shifts",
    "Scheduling.Shift.AssignmentChanged": "Scheduling_Shifts",
    "Scheduling.Template.ApplyModal.Applied": "Scheduling_Shifts",
    "Scheduling.ShiftSwap.Created": "Scheduling_Shifts",
    "Scheduling.ShiftSwap.Accepted": "Scheduling_Shifts",
    "Scheduling.ShiftHandover.Created": "Scheduling_Shifts",
    "Scheduling.ShiftHandover.Accepted": "Scheduling_Shifts",
    "Scheduling.OpenShiftRequest.Created": "Scheduling_Shifts",
    "Scheduling.OpenShiftRequest.Approved": "Scheduling_Shifts",
    "Mobile.Schedule.Loaded": "Scheduling_Shifts",
    "Shift.View.Opened": "Scheduling_Shifts",
    "ShiftDetails.View.Opened": "Scheduling_Shifts",
    "Absence.Request.Created": "Absence_Management",
    "Absence.Request.Approved": "Absence_Management",
    "Absence.Request.Rejected": "Absence_Management",
    "PunchClock.PunchedIn": "Time_Tracking",
    "Break.Activate.Started": "Time_Tracking",
    "Break.Activate.Finished": "Time_Tracking",
    "PunchClock.PunchedOut": "Time_Tracking",
    "PunchClockStartNote.Add.Completed": "Time_Tracking",
    "PunchClockEndNote.Add.Completed": "Time_Tracking",
    "PunchClock.Entry.Edited": "Time_Tracking",
    "Scheduling.Shift.Approved": "Approvals_Payroll",
    "Timesheets.BulkApprove.Confirmed": "Approvals_Payroll",
    "Integration.Xero.PayrollExport.Synced": "Approvals_Payroll",
    "Revenue.Budgets.Created": "Financials",
    "Communication.Message.Created": "Communication",
}


def fixture_category_map(variants: int = 6) -> dict[str, str]:
    """Dictionary for the events fixture, built by rule: ``<type>.<n>`` for
    n in 0..variants-1; ``error.*`` is left out on purpose (-> Other)."""
    by_type = {"click": "Engagement", "view": "Engagement", "purchase": "Commerce", "signup": "Onboarding"}
    return {f"{t}.{n}": cat for t, cat in by_type.items() for n in range(variants)}


def category_lookup(activity: Column, mapping: Mapping[str, str]) -> Column:
    """Literal map lookup; null when unmapped."""
    if not mapping:
        return F.lit(None).cast("string")
    kv = []
    for k, v in mapping.items():
        kv += [F.lit(k), F.lit(v)]
    return F.try_element_at(F.create_map(*kv), activity)


def attach_category(df: DataFrame, activity_col: str, mapping, out_col: str = "activity_category",
                    keep_null: bool = False) -> DataFrame:
    """Add ``out_col``: the mapped category, or 'Other' when unmapped
    (``keep_null=True`` leaves the null, to list unmapped names)."""
    if isinstance(mapping, DataFrame):
        # an activity that is listed twice takes the alphabetically first category
        m = mapping.toDF("_act", "_cat").groupBy("_act").agg(F.min("_cat").alias("_cat"))
        out = df.join(m, df[activity_col] == m["_act"], "left").drop("_act")
        cat = F.col("_cat")
        out = out.withColumn(out_col, cat if keep_null else F.coalesce(cat, F.lit(OTHER))).drop("_cat")
        return out
    cat = category_lookup(F.col(activity_col), mapping)
    return df.withColumn(out_col, cat if keep_null else F.coalesce(cat, F.lit(OTHER)))
