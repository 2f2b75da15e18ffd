"""Schemas of the tables, as DDL."""

POINTS = "area string, tile string, point_id bigint, x double, y double, z double, classification tinyint"
FOOTPRINTS = "area string, footprint_id string, lidar_derived boolean, methode string, source string, maj string, rings array<array<struct<x:double,y:double>>>"
REFERENCE_BUILDINGS = "area string, gml_id string, is_grouped boolean, parcelle string, n_roof_surfaces int, roof_area_m2 double, outline array<array<array<struct<x:double,y:double>>>>"
REFERENCE_ROOF_SURFACES = "area string, gml_id string, ordinal int, surface_id string, area_m2 double, slope_deg double, ring array<struct<x:double,y:double,z:double>>"
RECONSTRUCTIONS = (
    "area string, footprint_id string, status string, reason string, warnings array<string>, n_points int, density double, ground_z double, n_planes int, n_faces int, "
    "volume_m3 double, seconds double, run_id string, surface_kinds array<string>"
)
ROOF_FACES = "area string, footprint_id string, face int, plane_index int, nx double, ny double, nz double, d double, rings array<array<struct<x:double,y:double>>>"
BUILDING_RESULTS = (
    "area string, building_id string, footprint_id string, status string, roof_type string, outline_area_m2 double, share double, point_density double, lidar_derived boolean, n_ref_cells int, "
    "n_valid_cells int, sum_sq_m2 double, rmse_m double, coverage double, temporal_offset_m double, orientation_errors_deg array<double>, orientation_median_deg double, n_pred_planes int, "
    "n_ref_planes int, n_unmatched_pred int, n_unmatched_ref int, n_pred_faces int, n_ref_faces int, face_count_agreement double, reason string, warnings array<string>"
)
TABLES = {n.lower(): v for n, v in list(globals().items()) if n.isupper()}
