"""Schemas of what is read and written; nothing is inferred."""

PRODUCT = (
    "parent_asin string, title string, features array<string>, details map<string,string>, description array<string>, categories array<string>, "
    "store string, average_rating string, rating_number string, price string"
)
OUTCOME = ("sample_id string, scenario_type string, hit boolean, first_hit_turn int, best_rank int, reciprocal_rank double")
TRACE = (
    "event_type string, session_id string, turn int, intent_version int, dialogue_act string, route string, terms array<string>, filter_constraint_ids array<string>, "
    "total_matches bigint, returned_matches bigint, reason string, strict_candidate_count bigint, eligible_count bigint, rejected_product_ids array<string>, "
    "candidates array<struct<parent_asin:string,posterior:double>>, strict_product_ids array<string>, exploratory_product_ids array<string>, selected_attribute string"
)
CARD = "struct<target_category:string,hard_constraints:array<string>,soft_preferences:array<string>>"
CORPUS = (
    "sample_id string, scenario_type string, category_bucket string, difficulty_bucket string, ground_truth struct<parent_asin:string>, "
    "user_profile struct<purchase_frequency:string,average_prior_rating:double,rating_style:string,preference_tags:array<string>,summary:string>, "
    f"intent_card {CARD}, behavior struct<scenario_type:string,override:struct<turn:int,old_value:string,new_value:string,message:string>>, pair_id string, arm string"
)
SCHEMA_VERSION = 1
