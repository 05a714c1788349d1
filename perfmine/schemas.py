"""Fixed schemas. Nothing is inferred from data."""

from __future__ import annotations

from pyspark.sql import types as T

_S, _L, _D, _B = T.StringType(), T.LongType(), T.DoubleType(), T.BooleanType()


def _struct(**fields) -> T.StructType:
    return T.StructType([T.StructField(name, kind, True) for name, kind in fields.items()])


DATASET = _struct(
    repo=_S,
    after_commit=_S,
    issue_number=_L,
    exec_status=_S,
    exec_time_improvement=_D,
    p_value=_D,
    test_class_improvements=T.MapType(_S, T.ArrayType(_S)),
    before_commit=_S,
    pr_number=_L,
    is_improvement_per_manual_analysis=_S,
    modified_modules=T.ArrayType(_S),
    changed_files=T.ArrayType(_S),
)
DATASET_KEY = ["repo", "after_commit"]
# The steps a dataset row goes through, in order.
STATUSES = ("clone_and_checkout_repo", "docker_image_built", "maven_execution_successful")
SUCCESS_STATUS = STATUSES[-1]

COVERAGE_FILE = _struct(fileName=_S, coveredLines=_S)
COVERAGE_PATH = _struct(path=_S, files=T.ArrayType(COVERAGE_FILE))
COVERAGE_TEST = _struct(uniformPath=_S, result=_S, duration=_D, paths=T.ArrayType(COVERAGE_PATH))
COVERAGE_REPORT = _struct(tests=T.ArrayType(COVERAGE_TEST))

MESSAGE = _struct(role=_S, content=_S)
PROMPT = _struct(messages=T.ArrayType(MESSAGE), temp=_D, sample_size=_L, model=_S)
RESPONSE = _struct(samples=T.ArrayType(_struct(content=_S)))
INVOCATION = _struct(prompt=PROMPT, response=RESPONSE, invocation_time=_D)
ANSWER = _struct(prompt_hash=_S, version=_L, prompt=PROMPT, response=RESPONSE, invocation_time=_D)

YEAR_STAR_CACHE = _struct(
    commit_year_by_repo_sha=T.MapType(_S, T.IntegerType()), repo_stars=T.MapType(_S, _L)
)

EVALUATION = _struct(
    patch_applicable=_B,
    compile_success=_B,
    test_success=_B,
    significant_improvements=T.MapType(_S, T.ArrayType(_S)),
    original_exec_times=T.ArrayType(_D),
    patched_exec_times=T.ArrayType(_D),
)

PATCH_JUDGEMENT_COLUMNS = ("issue", "ground_truth_patch", "generated_patch", "judgment", "extra_info")
PRECISION_COLUMNS = ("issue_link", "ground_truth_patch", "is_exec_improvement", "functional_difference")
ACCURACY_COLUMNS = ("commit_url", "is_detected", "is_confirmed", "interesting")
