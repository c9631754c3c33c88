"""Lead-generation queries."""

from __future__ import annotations

from sitescope.operators import leads as L
from sitescope.plans import bindings as B
from sitescope.plans import sqlparts as S
from sitescope.plans.registry import register

# Radius used by the registered queries (the application's runner uses 5 km;
# the bench runs both).
QUERY_RADIUS_KM = 25.0
CFG = L.LeadConfig(hotspot_radius_km=QUERY_RADIUS_KM)
#: Every lead: the cut to the top 100 belongs to the lead lists, not to joins and maps over leads.
ALL_LEADS = L.LeadConfig(hotspot_radius_km=QUERY_RADIUS_KM, top_n=None)


@register('L6_normal_leads', S.leads_normal(QUERY_RADIUS_KM))
def normal_leads(spark, d):
    """Top-100 normal leads (trust + hotspot, deduped, nearest champion, priority score)."""
    return L.normal_leads(B.registry(spark, d), B.visited_sites(spark, d), CFG)


@register('L6_deprived_leads', S.leads_deprived())
def deprived_leads(spark, d):
    """Top-100 deprived-area leads (FSM >= 30) with their nearest champion."""
    return L.deprived_area_leads(B.registry(spark, d), B.visited_sites(spark, d), CFG)


BENCH_CFG = L.LeadConfig(hotspot_radius_km=5.0)


def bench_queries():
    """Extra bench-only variants: the application's own runner radius (5 km)."""
    from sitescope.plans.registry import finish

    def normal_5km(spark, d):
        return finish(L.normal_leads(B.registry(spark, d), B.visited_sites(spark, d), BENCH_CFG))
    return {'L6_normal_leads_5km': normal_5km}
