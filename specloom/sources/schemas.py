"""Declared schemas; nothing is inferred from data."""

VIEWS = (
    "row bigint, kernel_uid string, dish int, cell string, cell_index int, variety int, mode string, side string, "
    "day_folder int, hours double, coco_ann_id int, coco_image_id int, mask_px_raw int, mask_px int, "
    "patch_mask_px int, containment double, n_components_raw int, dropped_px int, clipped_frac double, "
    "sat_frac double, nan_frac double, fit_status string, source string"
)
SPECTRA = "row bigint, a array<float>"
PATCH_PIXELS = "row bigint, py int, px int, inside boolean, bands array<float>"
COCO = (
    "images array<struct<id: int, file_name: string, height: int, width: int>>, "
    "annotations array<struct<id: int, image_id: int, iscrowd: int, area: double, bbox: array<double>, "
    "segmentation: struct<counts: array<int>, size: array<int>>>>, "
    "categories array<struct<id: int, name: string>>"
)
CELLS = (
    "capture struct<mode: string, day: int, dish: int, side: string, source: string, render_shape: array<int>>, "
    "status string, reasons array<string>, flags array<string>, marker_ids array<int>, side_observed string, "
    "geometry struct<pitch_x_px: double, pitch_y_px: double, ratio: double, angle_deg: double, chirality: string, skew_deg: double>, "
    "pose struct<pose: string, dr: int, dc: int, score: double, margin: double>, "
    "frame struct<origin: array<double>, e_col: array<double>, e_row: array<double>>, "
    "cells array<struct<name: string, index: int, row: int, col: int, kind: string, marker_id: int, "
    "center: array<double>, corners: array<array<double>>, occupancy: double>>"
)
TIMING = (
    "t0_by_dish map<string, string>, "
    "captures map<string, struct<time: string, hours: double, source: string>>, "
    "visits_by_dish map<string, array<struct<hours: double>>>"
)
SPLITS = (
    "task string, group_col string, n_folds int, seed bigint, group_fold map<string, int>, "
    "folds array<struct<train: array<string>, test: array<string>>>"
)
PREDICTIONS = "dataset_row bigint, fold int, y_true int, y_pred int, score array<double>, kernel_uid string"
