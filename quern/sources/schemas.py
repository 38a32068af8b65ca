"""Schemas of the records that the engine reads and writes."""

SEED = "problem_id string, problem string, solution string"
SKILL_LABEL = "problem_id string, skills map<string,string>, attributes map<string,string>"
CLUSTER = "category string, members array<struct<skill:string,description:string>>"
TASK = (
    "task_id long, skill string, skill_description string, category string, task_type string, code string, input string, output string, "
    "imports array<string>, inputs array<string>, outputs array<string>, problem string, hints array<string>, detected_skill array<string>, "
    "difficulty double, reason string, feedback string, complexity_attributes array<string>, description string, "
    "skill_combination array<string>, crossover_description string, reasoning string"
)
ROLLOUT = "uid string, sample_idx int, data_source string, task_type string, prompt string, response string, ground_truth string, score double, acc double, format double, reward_raw double"
METRIC = "step long, name string, value double"
MESSAGES = "messages array<struct<role:string,content:string>>"
EVALUATION = "data_source string, responses array<string>, reward_model struct<ground_truth:string>"
