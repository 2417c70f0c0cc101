"""Declared field lists as Spark schemas."""

from __future__ import annotations

import json

from pyspark.sql.types import (
    ArrayType, BooleanType, DataType, DoubleType, LongType, MapType, StringType, StructField, StructType, TimestampType,
)

# Declared type names, and the fields of the three preset tables.
DECLARED_TYPES: dict[str, DataType] = {
    "string": StringType(), "integer": LongType(), "number": DoubleType(), "boolean": BooleanType(), "datetime": TimestampType(),
    "array[string]": ArrayType(StringType()), "object": MapType(StringType(), StringType()),
    "array[object]": ArrayType(MapType(StringType(), StringType())),
}
PRESETS: dict[str, tuple[str, str]] = {
    "ServiceNow Incident": ("incident", """
        sys_id:string number:string short_description:string description:string state:string impact:integer urgency:integer
        priority:integer category:string subcategory:string assignment_group:string caller_id:string opened_at:datetime
        updated_at:datetime close_code:string|null resolution_notes:string|null business_service:string _test_scenario:string
        _expected_category:string _expected_ticket_type:string _expected_required_skills:array[string] _expected_technology:string
        _expected_support_level:string _expected_assignment_group:string _expected_agent_action:string"""),
    "ServiceNow Change Request": ("change_request", """
        sys_id:string number:string short_description:string description:string type:string state:string risk:string impact:integer
        priority:integer assignment_group:string requested_by:string business_service:string planned_start_date:datetime
        planned_end_date:datetime implementation_plan:string backout_plan:string test_plan:string close_code:string|null
        close_notes:string|null _test_scenario:string _expected_assignment_group:string _expected_agent_action:string"""),
    "ServiceNow Service Catalog Request": ("sc_request", """
        sys_id:string number:string short_description:string description:string catalog_item:string request_type:string state:string
        stage:string approval:string priority:integer assignment_group:string requested_for:string requested_by:string
        opened_at:datetime due_date:datetime|null quantity:integer price:number currency:string business_service:string
        comments:string|null _test_scenario:string _expected_assignment_group:string _expected_agent_action:string"""),
}


def _field(name: str, declared: str, description: str = "") -> StructField:
    kind = declared.removesuffix("|null").strip() or "string"
    return StructField(name, DECLARED_TYPES.get(kind, StringType()), True, {"description": description, "declared_type": declared})


def schema_of_fields(definitions: str) -> StructType:
    """Schema of a JSON array of {name, type, description}. Names must be present and unique."""
    try:
        fields = json.loads(definitions)
    except json.JSONDecodeError as error:
        raise ValueError(f"The field list is not valid JSON: {error}") from error
    if not isinstance(fields, list) or not fields:
        raise ValueError("The field list must be a non-empty JSON array.")
    columns: dict[str, StructField] = {}
    for place, item in enumerate(fields, 1):
        name = str(item.get("name") or "") if isinstance(item, dict) else ""
        if not name:
            raise ValueError(f"Field {place} needs a name.")
        if name in columns:
            raise ValueError(f"Field name {name} occurs twice.")
        columns[name] = _field(name, str(item.get("type") or "string"), str(item.get("description") or ""))
    return StructType(list(columns.values()))


def table_schema(preset: str = "Custom", table_name: str = "", definitions: str = "") -> tuple[str, StructType]:
    """(table name, schema) of a preset or of a custom field list."""
    if preset in PRESETS:
        name, fields = PRESETS[preset]
        return name, StructType([_field(*f.split(":", 1)) for f in fields.split()])
    if preset != "Custom":
        raise ValueError(f"Unknown preset: {preset}")
    if not table_name.strip():
        raise ValueError("A custom table needs a name.")
    return table_name.strip(), schema_of_fields(definitions)


def prediction_schema(definitions: str, id_field: str = "number") -> StructType:
    return StructType([StructField(id_field, StringType()), *schema_of_fields(definitions).fields])


# Nested inputs of the policy datasets.
VULNERABILITY_CASE = """
    case_id string, _test_scenario string,
    ingestion_event struct<event_id:string,source:string,scanner_id:string,finding_id:string,observed_at:string,received_at:string>,
    scanner_finding struct<vulnerability_id:string,asset_ref:string,component:string,installed_version:string,fixed_version:string,
      scanner_severity:string,state:string,evidence_fingerprint:string>,
    cve_enrichment struct<cvss_score:double,cvss_vector:string,known_exploited:boolean,active_exploitation:boolean,epss:double,
      fix_available:boolean,published_at:string,advisory_type:string>,
    asset_context struct<asset_id:string,hostname:string,ip_address:string,asset_type:string,environment:string,region:string,
      internet_facing:boolean,business_criticality:string,business_service:string,owner_team:string,regulated_data:boolean,
      compliance_scopes:array<string>,patch_policy:string>,
    existing_state struct<canonical_findings:array<struct<canonical_finding_id:string,asset_id:string,state:string,first_seen_at:string,sources:array<string>>>,
      tickets:array<struct<ticket_id:string,canonical_finding_id:string,state:string,priority:string,due_at:string>>,
      remediation_jobs:array<struct<job_id:string,state:string,completed_at:string,failed_at:string>>,
      exceptions:array<struct<exception_id:string,scope:string,status:string,approved_by:string,expires_at:string,justification:string,review_ticket:string>>,
      validated_compensating_control:boolean,control:struct<control_id:string,type:string,valid_until:string>,product_lifecycle:string,
      current_inventory:struct<component:string,installed_version:string,collected_at:string>>"""
_RULE = "struct<name:string,equivalent:boolean,enabled:boolean,action:string,managed_by:string,overlaps_requested_flow:boolean>"
PROVISIONING_CASE = f"""
    case_id string, _test_scenario string,
    membership_event struct<event_id:string,event_type:string,server_id:string,pool_id:string,occurred_at:string,approved_change_id:string,idempotency_key:string>,
    server struct<server_id:string,hostname:string,ip_address:string,environment:string,location:string,network_zone:string,owner:string,
      illumio_workload_id:string,ven_state:string,cmdb_status:string>,
    application_pool struct<pool_id:string,application:string,environment:string,role:string,owner:string,lifecycle_state:string,
      security_tier:string,labels:map<string,string>>,
    approved_connectivity_intents array<struct<intent_id:string,status:string,direction:string,source:string,destination:string,
      protocol:string,port:int,source_zone:string,destination_zone:string,business_purpose:string>>,
    existing_state struct<illumio_rules:array<{_RULE}>,firewall_rules:array<{_RULE}>>"""
ACCESS_CASE = """
    case_id string, _test_scenario string,
    requester struct<user_id:string,role:string,groups:array<string>,authentication_level:string,authorized_safe_ids:array<string>>,
    user_query string,
    pam_context struct<
      accounts:array<struct<account_id:string,username:string,asset_id:string,safe_id:string,platform_id:string,environment:string,status:string,
        rotation_status:string,secret_present:boolean,last_rotated_at:string,next_rotation_at:string,checkout_policy:string,
        checkout_portal_path:string,description:string>>,
      safes:array<struct<safe_id:string,name:string,owner_group:string,memberships:array<struct<principal:string,principal_type:string,
        permissions:array<string>,granted_at:string,granted_by:string,approval_id:string>>>>,
      platforms:array<struct<platform_id:string,display_name:string,category:string,status:string,supports_rotation:boolean,supports_reconciliation:boolean>>,
      assets:array<struct<asset_id:string,hostname:string,ip_address:string,environment:string,application:string>>>,
    policy_context variant"""
KNOWLEDGE_DOCUMENT = """
    document_id string, source_system string, title string, version string, status string, effective_from timestamp, retired_at timestamp,
    owner_group string, access_scope array<string>, tags array<string>, chunks array<struct<chunk_id:string,content:string>>"""
SERVICE_REQUEST = """
    number string, request_type string, requested_by string, application_id string, state string, current_stage string,
    created_at timestamp, fields variant, approval_summary array<struct<approver_role:string,state:string,reason:string>>,
    status_events array<struct<at:timestamp,state:string,reason:string,verification:string>>"""
JOB = """
    job_name string, job_type string, box_name string, description string, region string,
    dependencies array<struct<job_name:string,condition:string>>, command string, owner_group string, timezone string, run_calendar string,
    scheduled_time_utc string, delivery_sla_minutes int, delivery_milestone_job string, child_jobs array<string>,
    base_duration_minutes int, volume_sensitive boolean, delivery_milestone boolean, terminal_for_box boolean"""
