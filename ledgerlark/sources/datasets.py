"""Typed projections of the published datasets: one table of columns for each, one loader for all."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from ledgerlark.functions import values as V

from .readers import crosswalk

#: How the text of a file becomes a column of a kind.
CLEANERS = {
    "text": V.blank_to_null,
    "money": V.parse_decimal,
    "whole": V.parse_int,
    "date": V.parse_date,
    "flag": V.parse_bool,
    "code": V.two_letter_code,
    "list": V.split_list,
}

# Columns of the datasets by kind; the key comes first.
DATASETS = {
    "grants": "_id:whole ref_number:text amendment_number:text amendment_date:date recipient_type:text recipient_business_number:text recipient_legal_name:text recipient_province:code prog_name_en:text agreement_value:money agreement_start_date:date owner_org:text owner_org_title:text is_amendment:flag",
    "identification": "bn:text fiscal_year:whole designation:text category:text legal_name:text account_name:text city:text province:code postal_code:text registration_date:date",
    "directors": "bn:text fpe:date sequence_number:whole last_name:text first_name:text position:text at_arms_length:flag start_date:date end_date:date",
    "qualified_donees": "bn:text fpe:date sequence_number:whole donee_bn:text donee_name:text associated:flag total_gifts:money gifts_in_kind:money",
    "financial_details": "bn:text fpe:date section_used:text field_4200:money field_4540:money field_4550:money field_4560:money field_4700:money field_5000:money field_5010:money field_5020:money field_5050:money field_5100:money",
    "compensation": "bn:text fpe:date field_300:whole field_390:money",
    "provincial_grants": "id:whole display_fiscal_year:text ministry:text recipient:text program:text amount:money lottery:flag payment_date:date",
    "provincial_contracts": "id:text display_fiscal_year:text recipient:text ministry:text amount:money",
    "sole_source": "id:text display_fiscal_year:text ministry:text vendor:text contract_number:text contract_services:text permitted_situations:text start_date:date end_date:date amount:money",
    "non_profits": "id:text type:text legal_name:text status:text registration_date:date city:text postal_code:text",
    "charitable_programs": "bn:text fpe:date program_type:code description:text",
    "foundation_info": "bn:text fpe:date field_100:flag field_110:money field_120:money field_130:money",
    "activities_outside_countries": "bn:text fpe:date sequence_number:whole country:code",
    "activities_outside_details": "bn:text fpe:date field_200:money field_210:flag field_220:flag",
    "exported_goods": "bn:text fpe:date sequence_number:whole item_name:text item_value:money destination:text country:code",
    "resources_sent_outside": "bn:text fpe:date sequence_number:whole individual_org_name:text amount:money country:code",
    "non_qualified_donees": "bn:text fpe:date sequence_number:whole recipient_name:text purpose:text cash_amount:money non_cash_amount:money country:code",
    "web_urls": "bn:text fiscal_year:whole sequence_number:whole contact_url:text",
    "linkage_records": "record_id:text source_dataset:text legal_name:text cleaned_name:text bn_root:text postal_code:text city:text province:code entity_type:text",
}


def columns_of(dataset: str) -> dict[str, str]:
    return dict(part.split(":") for part in DATASETS[dataset].split())


def typed(rows: DataFrame, dataset: str, headers: dict[str, str] | None = None) -> DataFrame:
    """Text columns of a file as the typed columns of a dataset; ``headers`` names those that the file calls otherwise."""
    wanted: dict[str, tuple[str, object]] = {c: ((headers or {}).get(c, c), CLEANERS[kind]) for c, kind in columns_of(dataset).items()}
    return crosswalk(rows, wanted)  # type: ignore[arg-type]
